"""Exact top-k similarity search in blocks, joins with passages, and filters around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.filters import apply_filters
from vectrine.functions.vector import METRICS, metric

QUERY_BLOCK, DATA_BLOCK = 2048, 65_536
ROUND = 6


def as_matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each owner by falling score, then id."""
    order = np.lexsort((ids, -score, owner))
    owner, score, ids = owner[order], score[order], ids[order]
    kept = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") < k
    return owner[kept], score[kept], ids[kept]


def _block_top_k(name: str, k: int, decode: Callable | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, queries (kind 0) first; memory holds a block of queries and one slice of data."""
    measure, at, held, queries = METRICS[name], None, [], None
    nothing = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    top = nothing

    def out() -> Iterator[pa.RecordBatch]:
        if len(top[0]):
            yield pa.RecordBatch.from_arrays([pa.array(queries[1][top[0]]), pa.array(top[2]), pa.array(top[1])], ["qid", "id", "score"])

    for batch in batches:
        one, other, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        edges = (np.flatnonzero((np.diff(one) != 0) | (np.diff(other) != 0) | (np.diff(kind) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(one)]):
            if a == b:
                continue
            if (one[a], other[a]) != at:
                yield from out()
                at, held, queries, top = (one[a], other[a]), [], None, nothing
            x = as_matrix(batch.column(4).slice(a, b - a))
            if kind[a] == 0:
                held.append((x, ids[a:b]))
                continue
            x = x if decode is None else decode(x)
            if queries is None:
                if not held:
                    continue
                queries = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for low in range(0, len(x), 2048):
                score = np.round(measure.scores(queries[0], x[low : low + 2048]), ROUND) + 0.0
                own = ids[a + low : min(b, a + low + 2048)]
                least = np.partition(score, len(own) - k, axis=1)[:, len(own) - k] if len(own) > k else np.full(len(score), -np.inf)
                rows, columns = np.nonzero(score >= least[:, None])
                top = best(
                    np.concatenate([top[0], rows]),
                    np.concatenate([top[1], score[rows, columns]]),
                    np.concatenate([top[2], own[columns]]),
                    k
                )
    yield from out()


def ranked(hits: DataFrame, k: int | None = None, score: str = "score", by: str = "qid") -> DataFrame:
    """``hits`` with a rank from 1 per query: best score first, ties to smaller ids; at most ``k`` of each."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k is not None else out).withColumn("rank", F.col("rank").cast("long"))


def exact_top_k(
    data: DataFrame,
    queries: DataFrame,
    k: int,
    metric_name: str = "mips",
    data_rows: int | None = None,
    query_rows: int | None = None,
    decode: Callable | None = None
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best of ``data`` (id, embedding) for each of ``queries`` (qid, embedding).

    Both sides are cut into blocks by a hash of their ids, and each pair of blocks is one task's unit: a task multiplies matrices
    and returns ``k`` rows a query, so neither side is ever broadcast or held whole.  decode: turns stored rows (codes) into vectors.  Scores are rounded to six digits before ranking.
    """
    name = metric(metric_name).name
    n, q = data.count() if data_rows is None else data_rows, queries.count() if query_rows is None else query_rows
    rows, columns = max(1, -(-q // QUERY_BLOCK)), max(1, -(-n // DATA_BLOCK))

    def blocks(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = queries.select(
        F.pmod(F.xxhash64("qid"), F.lit(rows)).cast("int").alias("one"),
        blocks(columns).alias("other"),
        F.lit(0).alias("kind"),
        F.col("qid").alias("id"),
        F.col("embedding").cast("array<float>").alias("x")
    )
    offered = data.select(
        blocks(rows).alias("one"),
        F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int").alias("other"),
        F.lit(1).alias("kind"),
        "id",
        F.col("embedding").cast("array<float>").alias("x")
    )
    tasks = asked.unionByName(offered).repartition("one", "other").sortWithinPartitions("one", "other", "kind")
    return ranked(tasks.mapInArrow(partial(_block_top_k, name, k, decode), "qid long, id long, score double"), k)


def search(
    passages: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric_name: str = "mips",
    filters: dict[str, Any] | None = None,
    filter_mode: str = "post"
) -> DataFrame:
    """Top-k search over ``passages`` (id, embedding, any other columns), joined with their other columns.

    ``post`` filters the k hits, so that fewer may remain; ``pre`` searches the rows that meet the filters only.
    """
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode is post or pre")
    if filter_mode == "pre":
        passages, filters = apply_filters(passages, filters), None
    hits = exact_top_k(passages.select("id", "embedding"), queries, k, metric_name)
    found = hits.join(passages.drop("embedding"), "id")
    return apply_filters(found, filters)


def rerank(hits: DataFrame, data: DataFrame, queries: DataFrame, k: int, metric_name: str = "mips") -> DataFrame:
    """Exact scores for a shortlist (qid, id), then its best ``k``: vectors are fetched for the shortlist only."""
    pairs = hits.select("qid", "id").join(data.select("id", F.col("embedding").alias("x")), "id").join(
        queries.select("qid", F.col("embedding").alias("q")), "qid"
    )
    return ranked(pairs.select("qid", "id", F.round(metric(metric_name).score("q", "x"), ROUND).alias("score")), k)
