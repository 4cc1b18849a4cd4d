"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances by one more component: with M the largest squared norm of the data, ``|q' - s'|^2 = |q|^2 + M - 2 q.s``.
Pivots are a bounded, seeded sample of the data.  Queries and data are grouped by nearest pivot; from the summaries of the groups (largest
distance of a query, smallest distances of data to each pivot) follows for every group of queries a bound on the distance of its k-th neighbour.  A
data vector goes to those groups only in which the triangle inequality leaves it a chance, and is compared with their queries
in blocks.  Scores are integers, computed exactly; only the pruning uses floating point, with a margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.llm.common import materialise, read

#: Pivots grow with the square root of the rows, between these bounds.
PIVOTS = (64, 2048)
QUERIES_PER_GROUP = 4096
ROWS_PER_BLOCK = 16_384
TASKS = 65_536
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding; rows with a null id, vector or component, or one that isn't finite, are left out."""
    whole = F.expr(
        "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('inf'))"
    )
    return vectors.select("vec_id", "embedding").where(whole)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else np.zeros((len(column), 0))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x); whole numbers that floating point holds exactly."""
    return np.floor(256 * x) + 0.0


def by_dimension(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, matrix, rows) of the rows of a batch."""
    column = batch.column(batch.schema.get_field_index(name))
    dims = np.array([len(v) for v in column]) if len(batch) else np.zeros(0, int)
    for dim in np.unique(dims):
        rows = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
        yield int(dim), matrix(rows.column(rows.schema.get_field_index(name)), int(dim)), rows


def distances(x: np.ndarray, pivots: np.ndarray, most: float, is_query: bool) -> np.ndarray:
    """Distances of augmented rows to augmented pivots; the added component of a query is 0."""
    nx, np_ = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", pivots, pivots)
    added = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(most - nx, 0))
    square = nx[:, None] + np_ - 2 * (x @ pivots.T) + (added[:, None] - np.sqrt(np.maximum(most - np_, 0))) ** 2
    return np.sqrt(np.maximum(square, 0))


def _asked(pivots: dict[int, np.ndarray], most: dict[int, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with their cell and their distance to its pivot."""
    for batch in batches:
        for dim, x, rows in by_dimension(batch, "embedding"):
            q = quantised(x)
            d = distances(q, pivots[dim], most[dim], True)
            cell = d.argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * dim), pa.array(q.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    lists,
                    pa.array(np.full(len(q), dim, np.int32)),
                    pa.array(cell.astype(np.int32)),
                    pa.array(d[np.arange(len(q)), cell])
                ],
                ["vec_id", "q", "dim", "cell", "d"]
            )


def _summary(pivots: dict[int, np.ndarray], most: dict[int, float], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell of this task: the k ids nearest to the pivot, each once, and a row without an id for its rows and their largest distance."""
    best: dict[tuple[int, int], dict[int, float]] = {}
    held: dict[tuple[int, int], tuple[int, float]] = {}
    for batch in batches:
        for dim, x, rows in by_dimension(batch, "embedding"):
            d = distances(quantised(x), pivots[dim], most[dim], False)
            cell = d.argmin(axis=1)
            d, ids = d[np.arange(len(x)), cell], rows.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                key = (dim, int(c))
                n, far = held.get(key, (0, 0.0))
                held[key] = (n + len(own), max(far, float(d[own].max())))
                near = best.setdefault(key, {})
                own = own[np.argsort(d[own], kind="stable")]
                _, first = np.unique(ids[own], return_index=True)
                for i in own[np.sort(first)[:k]].tolist():
                    near[int(ids[i])] = min(float(d[i]), near.get(int(ids[i]), np.inf))
                best[key] = dict(sorted(near.items(), key=lambda p: (p[1], p[0]))[:k])
    out = [(dim, cell, i, d, 0) for (dim, cell), near in best.items() for i, d in near.items()]
    out += [(dim, cell, None, far, n) for (dim, cell), (n, far) in held.items()]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["dim", "cell", "vec_id", "d", "n"]
    )


def _replicate(
    pivots: dict[int, np.ndarray],
    most: dict[int, float],
    reach: dict[int, list[tuple[int, np.ndarray]]],
    place: dict[int, tuple[np.ndarray, np.ndarray]],
    batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """reach: of a dimension, (group, farthest distance to each pivot at which a data vector can matter); place: first block of a cell, and how many."""
    for batch in batches:
        for dim, x, rows in by_dimension(batch, "embedding"):
            if dim not in reach:
                continue
            d = distances(quantised(x), pivots[dim], most[dim], False)
            cell = d.argmin(axis=1)
            mixed = (rows.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            first, parts = place[dim]
            block = first[cell] + mixed.astype(np.int64) % parts[cell]
            for group, far in reach[dim]:
                near = pa.array((d <= far).any(axis=1))
                part = rows.filter(near)
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), group, np.int32)),
                            pa.array(block).filter(near),
                            pa.array(np.ones(len(part), np.int32)),
                            part.column(0),
                            part.column(1)
                        ],
                        ["grp", "block", "kind", "vec_id", "embedding"]
                    )


def _wide(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as Python's integers."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows: by floating point or 64 bits where that is exact, else by wide integers; those beyond a long become its ends."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return a @ b.T
    if largest < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.zeros((len(a), len(b)), np.int64)
    # the few rows with huge components apart from the others
    one, other = (np.abs(m).max(axis=1, initial=0) >= 2**23 for m in (a, b))
    if not one.all() and not other.all():
        out[np.ix_(~one, ~other)] = exact_products(a[~one], b[~other]).astype(np.int64)
    clip = np.frompyfunc(lambda v: max(-LONG, min(LONG, v)), 1, 1)
    if one.any():
        out[one] = clip(_wide(a[one]) @ _wide(b).T).astype(np.int64)
    if other.any() and not one.all():
        out[np.ix_(~one, other)] = clip(_wide(a[~one]) @ _wide(b[other]).T).astype(np.int64)
    return out


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each owner, by falling score, then id."""
    order = np.lexsort((ids, -score, owner))
    owner, score, ids = owner[order], score[order], ids[order]
    first = np.searchsorted(owner, owner, side="left")
    kept = np.arange(len(owner)) - first < k
    return owner[kept], score[kept], ids[kept]


def _solve(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and block, queries (kind 0) first; memory holds a group's queries and one batch of data."""
    at, held, queries = None, [], None
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def out() -> Iterator[pa.RecordBatch]:
        if queries is not None and len(best[0]):
            q_ids, marks = queries[1], queries[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[best[0]]), pa.array(marks[best[0]]), pa.array(best[2]), pa.array(best[1].astype(np.int64))],
                ["query_id", "mark", "vec_id", "score"]
            )

    for batch in batches:
        grp, block, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        edges = (np.flatnonzero((np.diff(grp) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(grp)]):
            if a == b:
                continue
            if (grp[a], block[a]) != at:
                yield from out()
                at, held, queries = (grp[a], block[a]), [], None
                best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            part = batch.slice(a, b - a)
            name = "q" if kind[a] == 0 else "embedding"
            dim, x, _ = next(by_dimension(part, name))
            if kind[a] == 0:
                held.append((x, ids[a:b].astype(np.int64), (int(grp[a]) << 32) + sum(len(h[0]) for h in held) + np.arange(len(x))))
                continue
            if queries is None:
                if not held:
                    continue
                queries = tuple(np.concatenate(c) for c in zip(*held))
            x = quantised(x)
            for lo in range(0, len(x), 1024):
                y, y_ids = x[lo : lo + 1024], ids[a + lo : min(b, a + lo + 1024)].astype(np.int64)
                s = exact_products(queries[0], y)
                own = queries[1][:, None] == y_ids[None, :]
                s = np.where(own, np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf, s)
                least = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else s.min(axis=1)
                if len(best[0]):
                    count = np.bincount(best[0], minlength=len(s))
                    kth = np.full(len(s), s.dtype.type(-np.inf) if s.dtype != np.int64 else np.iinfo(np.int64).min, s.dtype)
                    np.minimum.at(bound := np.full(len(s), np.iinfo(np.int64).max, np.int64), best[0], best[1])
                    least = np.maximum(least, np.where(count >= k, bound, kth).astype(s.dtype))
                rows, columns = np.nonzero((s >= least[:, None]) & ~own)
                best = _best(
                    np.concatenate([best[0], rows]),
                    np.concatenate([best[1], s[rows, columns].astype(np.int64)]),
                    np.concatenate([best[2], y_ids[columns]]),
                    k
                )
    yield from out()


def clusters(counts: dict[int, int], between: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """(cells, parts): cells near one another share a cluster while their rows fit; a cell with more than ``most`` rows is one, of several parts."""
    left, out = dict(counts), []
    here, members = 0, []
    cell = min(left) if left else None
    while cell is not None:
        n = left.pop(cell)
        parts = -(-n // most)
        if members and (parts > 1 or here + n > most):
            out.append((members, 1))
            here, members = 0, []
        if parts > 1:
            out.append(([cell], parts))
        else:
            here, members = here + n, [*members, cell]
        rest = np.fromiter(left, np.int64, len(left))
        cell = int(rest[between[cell, rest].argmin()]) if len(rest) else None
    return [*out, (members, 1)] if members else out


def _pivots(data: DataFrame, dim: int, rows: int, wanted: int) -> np.ndarray:
    """A seeded sample of at most ``wanted`` vectors, without repeats."""
    drawn = F.xxhash64(F.lit(3), "vec_id")
    own = data.where(F.size("embedding") == dim)
    share = F.pmod(drawn, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4.0 * wanted / rows)) + 1
    some = own.where(share).orderBy(drawn, "vec_id", "embedding").limit(wanted).collect() or own.limit(1).collect()
    return np.unique(quantised(np.array([p["embedding"] for p in some], np.float64).reshape(len(some), dim)), axis=0)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` highest scores among all rows but those with its own id.

    is_query: a predicate on vec_id.  pivots: how many, of each dimension; else the square root of the rows, 64 to 2,048.  They, and as many
    summaries of cells, are all that reaches the driver.  A null id, a null vector, or a null or non-finite component takes no part.  Vectors
    of unequal dimension aren't compared.  Ties go to smaller ids.  Repeated data rows count one by one, repeated query rows once.  Scores are exact; one
    beyond a long becomes the nearest long, so that such scores tie.  An empty table, or no query, gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    data = materialise(usable(vectors), "vectors")
    # an upper bound of the squared norms of what is floored
    norm = F.expr("aggregate(embedding, 0D, (a, x) -> a + pow(256D * abs(cast(x as double)) + 1, 2))")
    sizes = {
        r["dim"]: r for r in data.groupBy(F.size("embedding").alias("dim")).agg(
            F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")
        ).collect()
    }
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sizes:
        return empty
    most = {dim: float(r["most"]) for dim, r in sizes.items()}
    chosen = {dim: _pivots(data, dim, r["n"], pivots or min(PIVOTS[1], max(PIVOTS[0], int(r["n"] ** 0.5)))) for dim, r in sizes.items()}
    queries = data.where(is_query).mapInArrow(partial(_asked, chosen, most), "vec_id long, q array<double>, dim int, cell int, d double")
    queries = materialise(queries.dropDuplicates(["vec_id", "q"]), "queries")
    asked = queries.groupBy("dim", "cell").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    if not asked:
        return empty
    told = materialise(
        data.mapInArrow(partial(_summary, chosen, most, k + 1), "dim int, cell int, vec_id long, d double, n long"), "summaries"
    )
    cells = told.where("vec_id is null").groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("d").alias("far")).collect()
    # of each cell: the k + 1 smallest distances of different ids (a query's own may be one of them); at most one row for each pivot
    nearest = told.where("vec_id is not null").groupBy("dim", "cell", "vec_id").agg(F.min("d").alias("d"))
    near = Window.partitionBy("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("d", "vec_id")
    least = nearest.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).groupBy("dim", "cell").agg(
        F.slice(F.sort_array(F.collect_list("d")), 1, k + 1).alias("least")
    ).collect()
    reach: dict[int, list[tuple[int, np.ndarray]]] = {}
    place: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # of each cell of queries: its first group, how many, and the runs of blocks that can hold a neighbour
    routes: list[tuple[int, int, int, int, list[tuple[int, int]]]] = []
    groups = blocks = tasks = 0
    for dim in sorted({r["dim"] for r in asked}):
        p = chosen[dim]
        between = distances(p, p, most[dim], False)
        ways = [(r["cell"], np.array(r["least"])) for r in least if r["dim"] == dim]
        bound: dict[int, float] = {}
        for r in (r for r in asked if r["dim"] == dim):
            upto = np.sort(np.concatenate([between[r["cell"], c] + d for c, d in ways]))
            bound[r["cell"]] = 2 * r["far"] + (upto[k] if len(upto) > k else np.inf)
        margin = 1e-6 * (1 + np.sqrt(most[dim]))
        held = {r["cell"]: r for r in cells if r["dim"] == dim}
        first, parts, runs = np.zeros(len(p), np.int64), np.ones(len(p), np.int64), []
        for members, n in clusters({c: r["n"] for c, r in held.items()}, between, ROWS_PER_BLOCK):
            first[members], parts[members] = blocks, n
            runs.append((members, blocks, n))
            blocks += n
        place[dim] = first, parts
        far_of = np.array([held[c]["far"] if c in held else 0.0 for c in range(len(p))])
        for members, n in clusters({r["cell"]: r["n"] for r in asked if r["dim"] == dim}, between, QUERIES_PER_GROUP):
            limit = np.array([bound[c] for c in members])
            targets = [
                (at, many) for cells_there,
                at,
                many in runs if (between[np.ix_(members, cells_there)] - far_of[cells_there] <= limit[:, None] + 2 * margin).any()
            ]
            farthest = np.full(len(p), -1.0)
            farthest[members] = limit + margin
            reach.setdefault(dim, []).extend((groups + j, farthest) for j in range(n))
            routes += [(dim, c, groups, n, targets) for c in members]
            groups += n
            tasks += n * sum(many for _, many in targets)
    where = spark.createDataFrame(routes, "dim int, cell int, first int, parts int, targets array<struct<at: long, many: long>>")
    # at most one row for each pivot
    asking = queries.join(F.broadcast(where), ["dim", "cell"]).select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("grp"),
        "vec_id",
        "q",
        F.explode("targets").alias("t")
    )
    asking = asking.select(
        "grp", F.explode(F.expr("sequence(t.at, t.at + t.many - 1)")).alias("block"), F.lit(0).alias("kind"), "vec_id", "q"
    )
    kind = data.schema["embedding"].dataType.simpleString()
    offered = data.mapInArrow(
        partial(_replicate, chosen, most, reach, place), f"grp int, block long, kind int, vec_id long, embedding {kind}"
    )
    both = asking.unionByName(offered, allowMissingColumns=True).repartition(max(1, min(tasks, TASKS)), "grp", "block")
    found = both.sortWithinPartitions("grp", "block", "kind", F.when(F.col("kind") == 0, F.col("vec_id")), "q").mapInArrow(
        partial(_solve, k), "query_id long, mark long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_exact_topk": op10_exact_topk}

_ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
ORACLES: dict[str, str] = {"op10_exact_topk": _ORACLE}
