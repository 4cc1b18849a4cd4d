"""Recall, latency and other measures of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, golden: DataFrame, by: str = "qid", item: str = "id") -> DataFrame:
    """Share of each query's golden items that were found; 0 for a query without golden ones.  Items count once."""
    a, b = found.select(by, item).distinct(), golden.select(by, item).distinct()
    sizes = b.groupBy(by).agg(F.count(F.lit(1)).alias("golden"))
    shared = a.join(b, [by, item], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("shared"))
    every = a.select(by).union(b.select(by)).distinct()
    return every.join(sizes, by, "left").join(shared, by, "left").select(
        by, F.coalesce(F.col("shared") / F.col("golden"), F.lit(0.0)).alias("recall")
    )


def upper_median_of(df: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value of each group, the higher of two, by ranks; no group is held in one row."""
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    upto = counted.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(by).agg(F.min(value).alias("median"))


def latency(df: DataFrame, by: str, seconds: str) -> DataFrame:
    """Mean, population deviation, maximum and throughput of timings."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(seconds).alias("mean"),
        F.stddev_pop(seconds).alias("std"),
        F.max(seconds).alias("most"),
        (F.count(F.lit(1)) / F.sum(seconds)).alias("per_second")
    )


def validity(df: DataFrame, by: str, score: str) -> DataFrame:
    """Share of scores that are finite numbers."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return df.groupBy(by).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("valid"))


def speedup(df: DataFrame, by: str, config: str, seconds: str, base: str, other: str) -> DataFrame:
    """Mean time of one configuration over that of another."""
    wide = df.groupBy(by).pivot(config, [base, other]).agg(F.avg(seconds))
    return wide.select(by, (F.col(f"`{base}`") / F.col(f"`{other}`")).alias("speedup"))


def memory(df: DataFrame, by: str, sample: str, order: str) -> DataFrame:
    """Peak of samples of memory, and how far it lies above the first sample."""
    first = F.min_by(sample, order)
    return df.groupBy(by).agg(F.max(sample).alias("peak"), (F.max(sample) - first).alias("delta"))


def memory_of_this_process() -> float:
    """MB that this process holds at its peak, for samples around a step."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
