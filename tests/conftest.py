import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["VECTRINE_HOME"] = str(tmp_path_factory.mktemp("home"))
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.fixture(scope="session")
def same_rows():
    """Compares a Spark frame with a DuckDB query, rows in any order."""

    def normal(frame):
        frame = frame[sorted(frame.columns)].copy()
        for c in frame.columns:
            if frame[c].dtype == object:
                frame[c] = frame[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
        return frame.astype(str).sort_values(list(frame.columns)).reset_index(drop=True)

    def check(df, sql, db):
        got, want = normal(df.toPandas()), normal(db.execute(sql).df())
        assert list(got.columns) == list(want.columns)
        assert len(got) == len(want)
        assert got.equals(want), (got != want).any(axis=1).sum()

    return check
