"""Product quantisation: codebooks, codes, and exact search: codes with a bound on their error rule vectors out, the others are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions.vector import metric, unit
from vectrine.operators import knn
from vectrine.operators.knn import as_matrix, exact_top_k, rerank

TRAIN_ROWS = 8_192
#: scores are rounded to six digits, and computed in floating point
SLACK, RELATIVE_SLACK = 2e-6, 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def train(vectors: DataFrame, parts: int = 16, codes: int = 64, rows: int = TRAIN_ROWS) -> list[np.ndarray]:
    """A codebook for each of ``parts`` slices of the vectors, from at most ``rows`` of them drawn by a seeded hash."""
    drawn = F.xxhash64(F.lit(13), "id")
    sample = vectors.select("id", "embedding").orderBy(drawn, "id").limit(rows).select("embedding").toArrow()
    x = as_matrix(sample["embedding"].combine_chunks())
    return [k_means(part, codes) for part in np.array_split(x, parts, axis=1)]


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, codes, error, length) of every vector: how far it is from what its codes decode to, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column(1)) if len(batch) else np.zeros((0, sum(b.shape[1] for b in books)))
            slices = np.array_split(x, len(books), axis=1)
            found = np.stack([((b**2).sum(axis=1)[None, :] - 2 * s @ b.T).argmin(axis=1) for b, s in zip(books, slices)], axis=1)
            error, length = np.linalg.norm(x - decode(books, found), axis=1), np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(found.astype(np.int16)), pa.list_(pa.int16())), pa.array(error), pa.array(length)],
                ["id", "codes", "error", "length"]
            )

    return vectors.select("id", F.col("embedding").cast("array<float>")).mapInArrow(
        run, "id long, codes array<short>, error double, length double"
    )


def decode(books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    return np.hstack([b[codes[:, i].astype(int)] for i, b in enumerate(books)])


def upper_bounds(name: str, queries: np.ndarray, decoded: np.ndarray, error: np.ndarray, length: np.ndarray) -> np.ndarray:
    """No score of a query with a vector is above its bound."""
    if name == "cosine":
        queries = unit(queries)
    sizes = np.linalg.norm(queries, axis=1)[:, None]
    products = queries @ decoded.T
    if name == "l2":
        far = np.sqrt(np.maximum(sizes**2 + (decoded**2).sum(axis=1) - 2 * products, 0))
        return -np.maximum(far - error, 0) ** 2 + SLACK + RELATIVE_SLACK * (sizes + length + error) ** 2
    bound = products + sizes * error + RELATIVE_SLACK * sizes * (length + error)
    return (bound / np.where(length == 0, 1, length) if name == "cosine" else bound) + SLACK


def _possible(name: str, books: list[np.ndarray], asking: pa.Table, codes: pa.Table) -> pa.Table:
    """Ids of a block of codes that may reach the k-th score found so far of some query of a block."""
    kept = []
    if len(asking) and len(codes):
        queries, least = as_matrix(asking["embedding"].combine_chunks()), asking["least"].to_numpy()[:, None]
        ids, error, length = (codes[c].to_numpy() for c in ("id", "error", "length"))
        held = as_matrix(codes["codes"].combine_chunks())
        for low in range(0, len(ids), 2048):
            part = slice(low, low + 2048)
            kept.append(ids[part][(upper_bounds(name, queries, decode(books, held[part]), error[part], length[part]) >= least).any(axis=0)])
    return pa.table({"id": pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64())})


def candidates(codes: DataFrame, books: list[np.ndarray], asked: DataFrame, metric_name: str, data_rows: int, query_rows: int) -> DataFrame:
    """id of each vector whose bound reaches ``least`` of some of ``asked`` (qid, embedding, least); in blocks, like ``exact_top_k``."""
    rows, columns = max(1, -(-query_rows // knn.QUERY_BLOCK)), max(1, -(-data_rows // knn.DATA_BLOCK))

    def blocks(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    name = metric(metric_name).name
    asking = asked.select(
        F.pmod(F.xxhash64("qid"), F.lit(rows)).cast("int").alias("one"),
        blocks(columns).alias("other"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        "least"
    )
    offered = codes.select(
        blocks(rows).alias("one"), F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int").alias("other"), "id", "codes", "error", "length"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _possible(name, books, left, right)

    return asking.groupBy("one", "other").cogroup(offered.groupBy("one", "other")).applyInArrow(run, "id long").distinct()


def search(
    vectors: DataFrame,
    codes: DataFrame,
    books: list[np.ndarray],
    queries: DataFrame,
    k: int = 10,
    shortlist: int = 256,
    metric_name: str = "mips"
) -> DataFrame:
    """The ``k`` best by exact score, whatever the codes lose.

    The exact scores of the ``shortlist`` best by codes give each query a k-th score to reach; vectors are fetched if the error of their codes
    leaves them that chance for some query.  A shortlist of any length gives the same result; codes of small errors rule more out.
    """
    n, q = codes.count(), queries.count()
    near = exact_top_k(
        codes.select("id", F.col("codes").alias("embedding")), queries, max(k, shortlist), metric_name, n, q, partial(decode, books)
    )
    # with fewer than k hits, nothing is ruled out
    least = rerank(near, vectors, queries, k, metric_name).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    asked = queries.select("qid", "embedding").join(least, "qid", "left").fillna(float("-inf"), "least")
    possible = candidates(codes, books, asked, metric_name, n, q)
    return exact_top_k(vectors.select("id", "embedding").join(possible, "id", "left_semi"), queries, k, metric_name, n, q)


def write_books(books: list[np.ndarray], spark: SparkSession, path: str) -> None:
    """Codebooks as rows (part, code, centre); there are at most parts times codes of them."""
    rows = [(p, c, [float(v) for v in centre]) for p, book in enumerate(books) for c, centre in enumerate(book)]
    spark.createDataFrame(rows, "part int, code int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_books(spark: SparkSession, path: str) -> list[np.ndarray]:
    rows = spark.read.parquet(path).orderBy("part", "code").collect()
    parts = sorted({r["part"] for r in rows})
    return [np.array([r["centre"] for r in rows if r["part"] == p]) for p in parts]


def shortlist(
    codes: DataFrame,
    books: list[np.ndarray],
    queries: DataFrame,
    complexity: int,
    metric_name: str,
    rows: int,
    query_rows: int | None = None
) -> DataFrame:
    """(qid, id) of the ``complexity`` vectors that score best by their codes; vectors or texts are fetched for these only."""
    return exact_top_k(
        codes.select("id", F.col("codes").alias("embedding")), queries, complexity, metric_name, rows, query_rows, partial(decode, books)
    ).select("qid", "id")


def enough(
    codes: DataFrame, books: list[np.ndarray], asked: DataFrame, golden: DataFrame, complexity: int, metric_name: str, rows: int, share: float = 0.98
) -> int:
    """How long a ``shortlist`` has to be, ``complexity`` or four times it again and again, to hold ``share`` of the exact hits ``golden`` (qid, id)
    of some queries ``asked``; all rows at most."""
    queries, wanted = asked.count(), share * golden.count()
    while complexity < rows:
        near = shortlist(codes, books, asked, complexity, metric_name, rows, queries)
        if near.join(golden, ["qid", "id"], "left_semi").count() >= wanted:
            break
        complexity *= 4
    return min(complexity, max(1, rows))


def code_parts(dimensions: int, memory_gb: float | None, rows: int) -> int:
    """Bytes of a code: as many as let ``rows`` codes fit into the memory that a search may take, 1 to ``dimensions``; a quarter of them by default."""
    if memory_gb is None:
        return max(1, dimensions // 4)
    return int(min(dimensions, max(1, memory_gb * 2**30 // max(1, rows))))


def memory_budget(index_bytes: int, available_gb: float, total_gb: float) -> tuple[float, float]:
    """GB that a search and a build may take: a tenth of the index and at least 0.1; half of what is free, at most 3/4 of all, at least 2."""
    return max(0.1, index_bytes / 2**30 / 10), max(2.0, min(0.5 * available_gb, 0.75 * total_gb))
