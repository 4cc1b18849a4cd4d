"""Sharding by a two-pass external shuffle.

The first pass scatters the records by a seeded hash of their place in the scan into buckets that fit into memory, by the bytes of the table; the
hash does not look at the records, so no key, source or group of copies can fill a bucket.  (Another layout of the files gives another order.)  The second pass takes one bucket at a time,
puts it in a seeded Fisher-Yates order and writes it.  The place of a record in that global order decides its shard and slot:
shards are runs of the order, and their counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrine.llm.common import read, running, shared_dir

SHARDS = 24
SEED = 20240607
BYTES_PER_BUCKET, RECORDS_PER_BUCKET = 8 << 20, 65_536
BUCKETS_PER_TASK = 8


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Where each place of a bucket's order comes from: Durstenfeld's exchanges with a seeded generator."""
    order = np.arange(n)
    if n > 1:
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1))
        held = order.tolist()
        for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
            held[i], held[j] = held[j], held[i]
        order = np.array(held)
    return order


def shard_and_slot(place: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places in the global order; the first ``total % shards`` shards hold one record more."""
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    early = place < edge
    shard = np.where(early, place // (small + 1), more + (place - edge) // max(small, 1))
    slot = np.where(early, place % (small + 1), (place - edge) % max(small, 1))
    return shard.astype(np.int32), slot.astype(np.int64)


def _shuffle(seed: int, total: int, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come one after another, each in order of ``place``, headed by a row that tells the bucket's start and count.

    Holds one bucket at a time.  Columns: row, bucket, place, start, n.
    """
    held: list[pa.RecordBatch] = []
    bucket = None

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        start, count = table["start"][0].as_py(), table["n"][0].as_py()
        if start is None or count != len(table) - 1:
            raise RuntimeError(f"bucket {bucket} has {len(table) - 1} records instead of {count}: the scan isn't the same each time")
        order = fisher_yates(count, seed, bucket)
        for at in range(0, count, 1024):
            part = table.select(["row"]).take(pa.array(order[at : at + 1024] + 1))
            shard, slot = shard_and_slot(np.arange(start + at, start + at + len(part)), total, shards)
            part = part.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot))
            yield from part.combine_chunks().to_batches()

    for batch in batches:
        own = batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(own)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(own)]):
            if b > a:
                if bucket is not None and own[a] != bucket:
                    yield from flush()
                    held = []
                bucket = int(own[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield from flush()


def weight(docs: DataFrame) -> Column:
    """About how many bytes a row holds: its strings and binaries as they are, eight for each item of an array, and for anything else."""
    parts = [F.lit(8 * len(docs.columns)).cast("long")]
    for f in docs.schema.fields:
        name = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            parts.append(8 * F.coalesce(F.size(name), F.lit(0)))
    return sum(parts[1:], parts[0])


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BYTES_PER_BUCKET,
    per_bucket: int = RECORDS_PER_BUCKET
) -> None:
    """Write all columns of ``docs`` with shard and slot to ``path``, a folder for each shard.

    A bucket holds about ``bucket_bytes`` or ``per_bucket`` records, whichever are fewer, and a task about eight buckets, whatever the session's number of
    shuffle partitions.  ``docs`` has to be a scan that gives the same rows in the same order each time, such as files (a bucket whose count differs
    stops the job); write anything else first.  Nulls, empty and long texts, ties and repeated rows are records like any others.  Columns
    named shard or slot are replaced, other names can't clash; an empty table writes no record.
    """
    columns = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    chosen = docs.select(*(F.col(f"`{c}`") for c in columns))
    total, size = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight(chosen)), F.lit(0))).first()
    buckets = max(1, -(-total // per_bucket), -(-size // bucket_bytes))
    placed = chosen.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.monotonically_increasing_id().alias("place"))
    scanned = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)))
    counts = scanned.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    heads = running(counts, [F.col("bucket")], {"upto": F.col("n")}, ["bucket", "n"]).select(
        "bucket", F.lit(-1).cast("long").alias("place"), (F.col("upto") - F.col("n")).alias("start"), "n"
    )
    scattered = scanned.unionByName(heads, allowMissingColumns=True).repartition(
        max(1, -(-buckets // BUCKETS_PER_TASK)), "bucket"
    ).sortWithinPartitions("bucket", "place")
    shuffled = scattered.select("row", "bucket", "place", "start", "n").mapInArrow(
        partial(_shuffle, seed, total, shards),
        T.StructType([placed.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    )
    shuffled.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written to the shared folder, texts and all; sizes and checksums are those of what was written."""
    docs = read(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path)
    if docs.isEmpty():
        return docs.selectExpr(
            "doc_id", "0L AS size", "0L AS text_crc32", "'rows' AS law", "0 AS shard", "0L AS slot", "cast(null AS int) AS grown_shard"
        )
    written = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    octets = F.coalesce("text", F.lit("")).cast("binary")
    return written.select(
        "doc_id",
        (F.octet_length(octets) + 8).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
