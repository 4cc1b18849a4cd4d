"""Browser history from SQLite, through a Python data source."""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vectrine.functions.text import chrome_time, history_document
from vectrine.schema import HISTORY


class _Slice(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.table = options["path"], options.get("table", "urls")
        self.columns = [f.name for f in schema.fields]
        self.pieces = int(options.get("partitions", "4"))
        if not self.table.isidentifier() or not all(c.isidentifier() for c in self.columns):
            raise ValueError("table and columns have to be plain names")

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids."""
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.pieces)
        return [_Slice(self.path, a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            yield from db.execute(
                f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)
            )


class SqliteSource(DataSource):
    """``spark.read.format("vectrine_sqlite").schema(...).option("table", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "vectrine_sqlite"

    def schema(self) -> str:
        return HISTORY

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("vectrine_sqlite").schema(schema).option("table", table).load(path)


def documents(rows: DataFrame, with_url: bool = False) -> DataFrame:
    """(text, title) of visits, and their url."""
    visited = F.date_format(chrome_time(F.col("last_visit_time")), "yyyy-MM-dd HH:mm:ss")
    title = F.coalesce("title", F.lit("No Title"))
    text = history_document(title, F.col("url"), visited, F.col("visit_count"), F.col("typed_count"))
    return rows.select(text.alias("text"), F.substring(title, 1, 150).alias("title"), *(["url"] if with_url else []))


def read(spark: SparkSession, path: str, max_count: int | None = None) -> DataFrame:
    """Documents (text, title) of visited pages, newest first."""
    rows = read_table(spark, path, "urls", HISTORY).where("hidden = 0 OR hidden IS NULL").orderBy(F.desc("last_visit_time"), "url")
    return documents(rows.limit(max_count) if max_count is not None and max_count >= 0 else rows)


def profiles(base: str | Path | None = None) -> list[Path]:
    """Folders of browser profiles that hold a history."""
    if base is None:
        home = Path.home()
        base = {"darwin": home / "Library/Application Support/Google/Chrome", "win32": home / "AppData/Local/Google/Chrome/User Data"}.get(
            sys.platform, home / ".config/google-chrome"
        )
    base = Path(base)
    return [p for p in [base / "Default", *sorted(base.glob("Profile *"))] if (p / "History").is_file()] if base.is_dir() else []


def export_tsv(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
