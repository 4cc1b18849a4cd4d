"""Chat exports: one JSON file for each contact."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing
from itertools import islice
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.text import safe_name
from vectrine.operators.messages import group_messages, message_line, readable_fields


def exports(base: str | Path) -> list[Path]:
    """Folders below ``base`` (or itself) that hold JSON exports."""
    base = Path(base)
    return [p for p in [base, *sorted(q for q in base.glob("*") if q.is_dir())] if any(p.glob("*.json"))] if base.is_dir() else []


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all JSON files below ``path``; the contact is the file's stem."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return parsed(raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("contact"), "value"))


def parsed(files: DataFrame) -> DataFrame:
    """(contact, pos, t, own, text) of JSON arrays of messages (contact, value); pos is the place in the array.

    A content that is text is read without prefixes; one that is an object gives its title, quoted, content and text.
    """
    raw = files.select("contact", F.parse_json("value").alias("v"))
    items = raw.select("contact", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "m"))
    get = lambda name, kind: F.try_variant_get("m", f"$.{name}", kind)
    text = F.coalesce(F.nullif(readable_fields(get("content", "variant")), F.lit("")), get("message", "string"), F.lit(""))
    return items.select(
        "contact",
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(get("createTime", "long"), F.lit(0)).cast("long").alias("t"),
        F.coalesce(get("isSentFromSelf", "boolean"), F.lit(False)).alias("own"),
        text.alias("text")
    )


def documents(messages: DataFrame, max_length: int = 1000, window_minutes: int = 30, overlap: int = 0) -> DataFrame:
    """Grouped messages as documents (contact, group_no, text), a line for each message."""
    keyed = messages.withColumn("conv", F.xxhash64("contact"))
    grouped = group_messages(keyed, max_length, window_minutes, overlap)
    lines = grouped.join(keyed.select("conv", "pos", "contact", "own"), ["conv", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", message_line(F.col("t"), F.col("own"), F.col("text")).alias("line"))))
    return lines.groupBy("contact", "group_no").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def with_contact(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """Each chunk says whose chat it is from."""
    return chunks.withColumn(text, F.concat(F.lit("[Contact] means the message is from: "), F.col("contact"), F.lit("\n"), F.col(text)))


def quoted(xml: str) -> Column:
    """Title and quoted text of a message card."""
    return F.concat_ws(" | ", F.expr(f"xpath_string({xml}, '//title')"), F.expr(f"nullif(xpath_string({xml}, '//refermsg/content'), '')"))


def export_text(messages: DataFrame, path: str) -> None:
    """Lines under a header for each contact, contacts kept together."""
    first = F.row_number().over(Window.partitionBy("contact").orderBy("pos")) == 1
    line = message_line(F.col("t"), F.col("own"), F.col("text"))
    rows = messages.withColumn("value", F.when(first, F.concat(F.lit("=== "), F.col("contact"), F.lit(" ===\n"), line)).otherwise(line))
    rows.repartition("contact").sortWithinPartitions("contact", "pos").select("value").write.mode("overwrite").text(path)


def export_json(messages: DataFrame, path: str) -> None:
    messages.withColumn("user", safe_name(F.col("contact"))).write.mode("overwrite").partitionBy("user").json(path)


def export_sqlite(messages: DataFrame, path: str, table: str = "messages", batch: int = 10_000) -> int:
    """Messages into a table of an SQLite file, streamed through one writer, as SQLite has only one; how many there were."""
    if not table.isidentifier():
        raise ValueError("the table has to be a plain name")
    rows = messages.select("contact", "pos", "t", "own", "text").orderBy("contact", "pos").toLocalIterator(prefetchPartitions=True)
    n = 0
    with closing(sqlite3.connect(path)) as db:
        db.execute(f"DROP TABLE IF EXISTS {table}")
        db.execute(f"CREATE TABLE {table} (contact TEXT, pos INTEGER, t INTEGER, own INTEGER, text TEXT)")
        while part := list(islice(rows, batch)):
            db.executemany(f"INSERT INTO {table} VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in part])
            n += len(part)
        db.commit()
    return n


def unwrapped(xml: str | None) -> str:
    """Title and quoted text of a message card, cards within cards included; what isn't XML stays as it is."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return (xml or "").strip()
    found = [t.text.strip() for t in root.iter("title") if (t.text or "").strip()]
    for quoted_part in root.iter("refermsg"):
        inner = unwrapped(quoted_part.findtext("content"))
        found += [inner] if inner else []
    return " | ".join(dict.fromkeys(found))


def pulled(fetch: Callable[[str, int, int], list[dict]], contact: str, page: int = 500) -> Iterator[dict]:
    """Messages of a contact from a service that answers ``fetch(contact, offset, limit)``, page by page until one is short."""
    at = 0
    while True:
        part = fetch(contact, at, page)
        yield from part
        at += len(part)
        if len(part) < page:
            return
