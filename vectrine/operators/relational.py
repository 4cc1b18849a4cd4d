"""Small relational operators: budgets, sets, prefix sums, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.storage import written


def budget_across_sources(rows: DataFrame, limit: int, source: str, order: str) -> DataFrame:
    """The first ``limit`` rows, sources in order, then rows in order (both orders in one sort, top rows per task first)."""
    return rows.orderBy(source, order).limit(limit)


def newest(rows: DataFrame, time: str, limit: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(time), tie).limit(limit)


def prefix_sum(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``value`` before each row in ascending ``order``.

    Rows are split into ranges of the order, whatever its values are, and written; the ranges' sums meet in one task, a row for each
    of the session's shuffle partitions at most.
    """
    ranged = written(rows.repartitionByRange(order).withColumn("_r", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_r").agg(F.sum(value).alias("_v")).select("_r", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_r").withColumn(
        "upto", F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))
    ).drop("_r", "_start")


def byte_offsets(rows: DataFrame, order: str, text: str) -> DataFrame:
    """``rows`` with ``offset``, where each record's line begins in a file of UTF-8 lines in ascending ``order``."""
    sized = rows.withColumn("_size", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1)
    return prefix_sum(sized, order, "_size").withColumnRenamed("upto", "offset").drop("_size")


def first_positions(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key at its first position (order-preserving distinct)."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def name_matches(projects: DataFrame, name: str, current: str | None = None) -> DataFrame:
    """Indexes of ``projects`` (project, base, parent) whose own name or whose folder's name is ``name``; the current project first."""
    hit = projects.where((F.col("base") == name) | (F.col("parent") == name)).dropDuplicates(["project", "base", "parent"])
    return hit.withColumn("is_current", F.col("project") == F.lit(current or "")).orderBy(F.desc("is_current"), "project", "base")


def absent(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row that counts the rows meeting each condition."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
