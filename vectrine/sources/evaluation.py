"""Evaluation data: sets of queries and their golden passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, and qid if the lines name one) of JSON lines; blank queries are left out."""
    rows = spark.read.schema("qid long, query string").json(path)
    return rows.where(F.coalesce(F.trim("query"), F.lit("")) != "")


def golden(spark: SparkSession, path: str, k: int = 3) -> DataFrame:
    """(qid, rank, id) of the first ``k`` golden ids of each query.

    Either lines ``{"qid": 7, "indices": [4, 9]}``, which are read in parts, or one document ``{"indices": [[4, 9], [1]]}`` whose lists
    are those of queries 0, 1, 2 and so on.
    """
    raw = spark.read.text(path, wholetext=False).select(F.try_parse_json("value").alias("v"))
    indices = F.try_variant_get("v", "$.indices", "variant")
    nested = F.try_variant_get(F.try_variant_get("v", "$.indices[0]", "variant"), "$", "array<long>")
    one = raw.where(nested.isNotNull()).select(F.posexplode(F.try_variant_get(indices, "$", "array<array<long>>")).alias("qid", "ids"))
    lines = raw.where(nested.isNull()).select(
        F.try_variant_get("v", "$.qid", "long").alias("qid"), F.try_variant_get(indices, "$", "array<long>").alias("ids")
    )
    every = one.select(F.col("qid").cast("long").alias("qid"), "ids").unionByName(lines)
    return every.where("qid is not null").select("qid", F.posexplode(F.slice("ids", 1, k)).alias("rank", "id")).select(
        "qid", (F.col("rank") + 1).cast("long").alias("rank"), "id"
    )


def golden_texts(golden_rows: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, rank, text): the golden passages (id, text) themselves; ids without one are left out."""
    return golden_rows.join(passages.select("id", "text"), "id").select("qid", "rank", "text")


def recall_by_text(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, recall) of found texts among wanted ones (qid, text): texts are compared, as ids of several indexes differ."""
    a, b = found.select("qid", "text").distinct(), wanted.select("qid", "text").distinct()
    sizes = b.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = a.join(b, ["qid", "text"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return sizes.join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def corpus(
    spark: SparkSession, rows: int, topics: int = 10, template: str = "This is document %d about topic %d.", seed: int = 42
) -> DataFrame:
    """(id, text, topic) of synthetic documents: a template, then words drawn by a seeded hash of id and place."""
    words = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(97)).cast("string"))
    )
    topic = F.pmod("id", F.lit(topics))
    return spark.range(rows).select(
        "id", F.concat_ws(" ", F.format_string(template, "id", topic), F.array_join(words, " ")).alias("text"), topic.alias("topic")
    )

