"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local session (one machine, as in tests) that leaves it unset gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="vectrine-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(
    rows: DataFrame, order: list[Column], sums: dict[str, Column], keep: list[str], by: list[str] | None = None
) -> DataFrame:
    """``rows`` with running totals (own row included) of ``sums`` in ``order``, for each value of ``by``; no task sees all rows.

    Rows are split into ranges of ``by`` and ``order``, as many as the session's shuffle partitions (fewer if they are small), written, and each
    range's totals are carried on to the next ones.  Rows equal in both can be
    split between ranges only if ``order`` ends with something that tells them apart.
    """
    by = by or []
    ranged = materialise(
        rows.repartitionByRange(*by, *order).select(
            *keep, *(v.alias(k) for k, v in sums.items()), F.spark_partition_id().alias("_range")
        ),
        "ranges"
    )
    totals = ranged.groupBy("_range", *by).agg(*(F.sum(k).alias(k) for k in sums))
    # at most one row of each range for each value of ``by``
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", *by, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*keep, "_range", *(F.sum(k).over(within).alias(k) for k in sums))
    same = ["_range", *by]
    return local.join(F.broadcast(carried) if not by else carried, same).select(
        *keep, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums)
    )


#: Rows of a lookup table that may be broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 100_000


def small_lookup(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Join ``rows`` with ``table``, which is unique by ``key`` and written already: by broadcast if it is counted to be small, else salted."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    return salted_lookup(rows, table, key, 64)


#: A key with more than one in so many of all rows is hot; so there are fewer hot keys than that.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table`` by ``key``; rows of the keys in ``hot`` (fewer than ``HOT_SHARE``, broadcast) are spread over ``salts`` tasks.

    Only the entries of ``table`` with such a key are copied.
    """
    marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("long")
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    spread = rows.join(marked, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = table.join(marked, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_hot")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """The keys with more than one in ``HOT_SHARE`` of ``total`` rows."""
    return counts.where(F.col(weight) * HOT_SHARE > total).select(key).limit(HOT_SHARE)


def salted_lookup(rows: DataFrame, small: DataFrame, key: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``small``, which is unique by ``key``, so that a hot key of ``rows`` falls into ``salts`` tasks."""
    spread = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*key, "_salt"], how).drop("_salt")


def id_crc(column: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
