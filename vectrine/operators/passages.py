"""Passages: rows (id, pos, text, metadata VARIANT) as Parquet, with lookup by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_documents(docs: DataFrame, id_column: str | None = None, text: str = "text") -> DataFrame:
    """Passages of ``docs``: id is that column's text, or else the position; the other columns become metadata.

    Positions follow the order of the scan; blank texts are left out before they are counted.
    """
    kept = docs.where(F.col(text).isNotNull() & (F.regexp_replace(text, "(?U)\\s+", "") != ""))
    others = [c for c in docs.columns if c not in (text, id_column)]
    packed = F.to_variant_object(F.struct(*others)) if others else F.parse_json(F.lit("{}"))
    # positions without one task that sees all rows: counts of the scan's parts, then places within them
    numbered = kept.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = numbered.join(before, "_part").withColumn("pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    key = F.col(id_column).cast("string") if id_column else F.col("pos").cast("string")
    return placed.select(key.alias("id"), "pos", F.col(text).alias("text"), packed.alias("metadata"))


def placeholders(ids: DataFrame) -> DataFrame:
    """Passages for bare ids, as when only vectors are given."""
    return ids.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Document "), F.col("id").cast("string")).alias("text"))


def write_json_lines(passages: DataFrame, path: str) -> None:
    passages.write.mode("overwrite").json(path)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Passages of several JSON-lines shards, with the shard's place in ``paths``."""
    parts = [
        spark.read.schema("id string, text string, metadata variant").json(p).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_shard_wins(passages: DataFrame, key: str = "id", shard: str = "shard") -> DataFrame:
    """One row for each id: that of the first shard holding it."""
    others = [c for c in passages.columns if c not in (key, shard)]
    best = F.min_by(F.struct(*others), F.col(shard))
    return passages.groupBy(key).agg(F.min(shard).alias(shard), best.alias("_b")).select(
        key, shard, *(F.col(f"_b.{c}").alias(c) for c in others)
    )


def lookup(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """``hits`` joined with their passages; ids without one are dropped."""
    return hits.join(passages, "id")


def get(passages: DataFrame, passage_id: str):
    """The passage of one id; ``KeyError`` if there is none."""
    found = passages.where(F.col("id") == passage_id).limit(1).collect()
    if not found:
        raise KeyError(passage_id)
    return found[0]


def aligned(passages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Passages with their embeddings by id; unequal counts are an error."""
    a, b = passages.count(), embeddings.count()
    both = passages.join(embeddings.select(F.col("id").cast("string").alias("id"), "embedding"), "id")
    if a != b or both.count() != a:
        raise ValueError(f"{a} passages don't match {b} embeddings")
    return both
