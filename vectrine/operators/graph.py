"""A proximity graph in memory-sized shards, searched best-first; vectors can be recomputed for the visited nodes only.

Vectors near one another share a shard: cells around centres that are trained on a bounded sample, large cells in several shards.  A query goes to the
shards whose means are nearest to it.  Build: nearest candidates of each node, pruned so that no neighbour is closer to a kept one than to the node (robust pruning, factor
``alpha``), with reverse edges; hubs keep up to twice the degree.  Equal vectors of a shard are one node of its graph, so that copies
can't fill one another's candidates.  Search: a beam over each shard, for a slice of queries at once, hits with their copies, then one global top-k.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.vector import METRICS, metric, unit
from vectrine.operators.embed import EMBEDDERS
from vectrine.operators.knn import as_matrix, exact_top_k, ranked
from vectrine.operators.pq import decode, k_means

ROWS_PER_SHARD = 4_096
#: A shard goes once to each block of its queries, with its vectors or texts; a block is searched in slices.
QUERIES_PER_BLOCK, QUERIES_PER_SLICE = 8_192, 256
HUB_SHARE = 0.02
STRATEGIES = ("global", "local", "proportional")
CELLS, SAMPLE_ROWS = 1_024, 16_384
BROADCAST_SHARDS = 100_000
GRAPH = "shard int, node long, level int, neighbors array<long>, centre array<float>"


def _connect(x: np.ndarray, neighbours: list[list[int]], entry: int) -> None:
    """Make every node reachable: where a search can't come, the nearest pair across is joined both ways, and the entry leads there at once."""
    reached = np.zeros(len(x), bool)
    waiting = [entry] if len(x) else []
    while waiting:
        reached[waiting] = True
        while waiting:
            for w in neighbours[waiting.pop()]:
                if not reached[w]:
                    reached[w] = True
                    waiting.append(w)
        left = np.flatnonzero(~reached)
        if len(left):
            node = int(left[((x[left] - x[entry]) ** 2).sum(axis=1).argmin()])
            inside = np.flatnonzero(reached)
            near = int(inside[((x[inside] - x[node]) ** 2).sum(axis=1).argmin()])
            for v in {near, entry}:
                neighbours[v] = [*neighbours[v], node]
            neighbours[node] = list(dict.fromkeys([near, *neighbours[node]]))
            waiting = [node]


def _build(name: str, degree: int, candidates: int, alpha: float, table: pa.Table) -> pa.Table:
    ids = table["id"].to_numpy()
    order = np.argsort(ids)
    ids, x = ids[order], as_matrix(table["embedding"].combine_chunks())[order]
    if name == "cosine":
        x = unit(x)
    # the graph is that of distinct vectors; each stands under the smallest of its ids
    every_id = ids
    mean = x.mean(axis=0) if len(x) else None
    _, first, group = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True) if len(x) else (
        x, np.zeros(0, int), np.zeros(0, int)
    )
    owner = first[group.reshape(-1)]
    first = np.sort(first)
    ids, x = ids[first], x[first]
    if name == "mips":
        # one more component makes inner products distances
        lengths = (x**2).sum(axis=1)
        x = np.hstack([x, np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))[:, None]])
    n = len(x)
    squares = (x**2).sum(axis=1)
    out: list[list[int]] = []
    for low in range(0, n, 512):
        d = squares[low : low + 512, None] + squares[None, :] - 2 * (x[low : low + 512] @ x.T)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        m = min(candidates, n - 1)
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(d), 0), int)
        for row, found in zip(d, near):
            pool = found[np.argsort(row[found], kind="stable")]
            between = squares[pool][:, None] + squares[pool][None, :] - 2 * (x[pool] @ x[pool].T)
            alive, kept = np.ones(len(pool), bool), []
            for i in range(len(pool)):
                if alive[i]:
                    kept.append(int(pool[i]))
                    if len(kept) == degree:
                        break
                    alive &= alpha * alpha * between[i] > row[pool]
            out.append(kept)
    reverse: list[list[int]] = [[] for _ in range(n)]
    for node, kept in enumerate(out):
        for other in kept:
            reverse[other].append(node)
    popular = np.array([len(r) for r in reverse])
    bar = np.sort(popular)[-max(1, int(np.ceil(HUB_SHARE * n)))] if n else 0
    neighbours = []
    for node in range(n):
        limit = 2 * degree if popular[node] >= bar else degree
        every = list(dict.fromkeys(out[node] + reverse[node]))
        if len(every) > limit:
            d = squares[every] - 2 * (x[every] @ x[node])
            forward = out[node][: limit // 2]
            rest = [every[i] for i in np.argsort(d, kind="stable") if every[i] not in set(forward)]
            every = forward + rest[: limit - len(forward)]
        neighbours.append(every)
    centre = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if n else -1
    _connect(x, neighbours, centre)
    neighbours = [ids[every].tolist() for every in neighbours]
    levels = [1 if i == centre else 0 for i in range(n)]
    copies = np.flatnonzero(owner != np.arange(len(owner)))
    of = np.searchsorted(first, owner[copies])
    neighbours += [[int(ids[i]), *neighbours[i]] for i in of]
    nodes = np.concatenate([ids, every_id[copies]])
    centres = [mean.tolist() if level == 1 else None for level in levels] + [None] * len(copies)
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()] * len(nodes), pa.int32()),
            "node": pa.array(nodes, pa.int64()),
            "level": pa.array(levels + [-1] * len(copies), pa.int32()),
            "neighbors": pa.array(neighbours, pa.list_(pa.int64())),
            "centre": pa.array(centres, pa.list_(pa.float32()))
        }
    )


def shard_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_SHARD))


def shard_bound(rows: int) -> int:
    """No graph of so many rows has more shards: each cell's last one may be partly filled."""
    shards = shard_count(rows)
    return shards if shards == 1 else shards + min(CELLS, shards)


def placed(vectors: DataFrame, name: str, shards: int, rows: int, sample: DataFrame | None) -> DataFrame:
    """``vectors`` (id, embedding) with their shard; of one shard nothing is trained."""
    if shards == 1:
        return vectors.withColumn("shard", F.lit(0))
    drawn = F.xxhash64(F.lit(17), "id")
    some = (vectors if sample is None else sample).where(F.pmod(drawn, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE_ROWS / rows)))
    x = as_matrix(
        some.select("id", "embedding").orderBy(drawn, "id").limit(SAMPLE_ROWS).select(
            F.col("embedding").cast("array<float>").alias("e")
        ).toArrow()["e"].combine_chunks()
    )
    x = unit(x) if name == "cosine" else x
    centres = k_means(x, min(CELLS, shards))
    squares = (centres**2).sum(axis=1)
    # the sample tells how large the cells are, and so how many shards each takes
    share = (np.bincount((squares - 2 * x @ centres.T).argmin(axis=1), minlength=len(centres)) + 1) / (len(x) + len(centres))
    parts = np.maximum(1, np.ceil(share * rows / ROWS_PER_SHARD)).astype(np.int64)
    first = np.cumsum(parts) - parts

    def run(batches):
        for batch in batches:
            y = as_matrix(batch.column(1)) if len(batch) else np.zeros((0, centres.shape[1]))
            cell = (squares - 2 * (unit(y) if name == "cosine" else y) @ centres.T).argmin(axis=1)
            mixed = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = first[cell] + mixed.astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shard.astype(np.int32))], ["id", "embedding", "shard"]
            )

    return vectors.mapInArrow(run, "id long, embedding array<float>, shard int")


def build(
    vectors: DataFrame,
    metric_name: str = "mips",
    degree: int = 32,
    candidates: int = 200,
    alpha: float = 1.2,
    rows: int | None = None,
    sample: DataFrame | None = None
) -> DataFrame:
    """(shard, node, level, neighbors, centre) of ``vectors`` (id, embedding); level 1 marks the entry point of a shard, which holds the shard's mean.

    Level -1 marks a copy: its first neighbour is the node that holds the same vector, the others are that node's.  sample: vectors to train the
    cells on, where ``vectors`` would be computed twice; at most 16,384 of them are used.
    """
    name = metric(metric_name).name
    rows = vectors.count() if rows is None else rows
    held = placed(vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")), name, shard_count(rows), rows, sample)

    def run(table):
        return _build(name, degree, candidates, alpha, table)

    return held.groupBy("shard").applyInArrow(run, GRAPH)


def layout(graph: DataFrame, data: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The graph beside each node's vector or text (and codes), in order of shards: what a search reads, without a join."""
    held = graph.join(data.select(F.col("id").alias("node"), *(c for c in data.columns if c in ("embedding", "text"))), "node")
    if codes is not None:
        held = held.join(codes.select(F.col("id").alias("node"), "codes"), "node")
    return held.repartitionByRange("shard").sortWithinPartitions("shard", "node")


def beam(
    entry: int,
    neighbours: Callable[[int], list[int]],
    score: Callable[[list[int]], np.ndarray],
    complexity: int,
    beam_width: int = 1,
    choose: Callable[[list[list[int]]], list[int]] | None = None,
    stop_early: bool = True
) -> tuple[dict[int, float], int]:
    """Scores of the ``complexity`` best nodes found, and how many nodes were scored.

    choose: which of the nodes first seen in a step (by expanded node) are scored.
    """
    first = float(score([entry])[0])
    # best first, and worst first; ties go to smaller nodes
    waiting, top = [(-first, entry)], [(first, -entry)]
    passed, scored = {entry}, 1
    while waiting:
        if stop_early and len(top) >= complexity and -waiting[0][0] < top[0][0]:
            break
        step = [heapq.heappop(waiting)[1] for _ in range(min(beam_width, len(waiting)))]
        fresh = []
        for v in step:
            fresh.append(sorted(set(neighbours(v)) - passed))
            passed.update(fresh[-1])
        new = sorted(w for own in fresh for w in own) if choose is None else choose(fresh)
        if not new:
            continue
        scored += len(new)
        for w, s in zip(new, score(new).tolist()):
            if len(top) < complexity:
                heapq.heappush(top, (s, -w))
                heapq.heappush(waiting, (-s, w))
            elif (s, -w) > top[0]:
                heapq.heapreplace(top, (s, -w))
                heapq.heappush(waiting, (-s, w))
    return {-v: s for s, v in top}, scored


def chooser(strategy: str, ratio: float, near: Callable[[list[int]], np.ndarray]) -> Callable[[list[list[int]]], list[int]]:
    """Drops the share ``ratio`` of new nodes that codes place farthest: of each expanded node's (local), of the step's (proportional), or
    of all that wait in one queue (global; those that stay in it can still be taken in later steps)."""
    queue: list[tuple[float, int]] = []

    def best(nodes: list[int]) -> list[int]:
        order = np.argsort(-near(nodes), kind="stable") if nodes else []
        return [nodes[i] for i in order[: max(1, round(len(nodes) * (1 - ratio)))]]

    def choose(fresh: list[list[int]]) -> list[int]:
        every = sorted(w for own in fresh for w in own)
        if strategy == "local":
            return sorted(w for own in fresh for w in best(own))
        if strategy == "proportional":
            return sorted(best(every))
        for w, s in zip(every, near(every).tolist() if every else []):
            heapq.heappush(queue, (-s, w))
        wanted = max(1, round(len(every) * (1 - ratio))) if every else 0
        return sorted(heapq.heappop(queue)[1] for _ in range(min(wanted, len(queue))))

    return choose


class _Walk:
    """Beams of many queries over one shard in step, with the results of ``beam`` of width 1."""

    def __init__(self, name: str, keys: list[int], near: list[list[int]], entry: int, vectors: Callable[[list[int]], np.ndarray]):
        self.name, self.keys, self.vectors = name, keys, vectors
        n, at = len(keys), {v: i for i, v in enumerate(keys)}
        self.entry = at[entry]
        near = [sorted({at[w] for w in own}) for own in near]
        # places that a node doesn't fill hold n, which counts as passed
        self.near = np.full((n, max(1, *map(len, near))), n)
        for row, own in zip(self.near, near):
            row[: len(own)] = own
        self.x: np.ndarray | None = None
        self.known = np.zeros(n, bool)

    def _load(self, wanted: np.ndarray) -> None:
        fresh = np.unique(wanted[~self.known[wanted]])
        if len(fresh):
            found = self.vectors([self.keys[i] for i in fresh.tolist()])
            if self.x is None:
                self.x = np.zeros((len(self.keys), found.shape[1]))
            self.x[fresh] = unit(found) if self.name == "cosine" else found
            self.known[fresh] = True

    def _scores(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of pairs of a query and a node."""
        self._load(nodes)
        a, b = q[rows], self.x[nodes]
        products = np.einsum("ij,ij->i", a, b)
        if self.name != "l2":
            return products
        return -np.maximum(np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b) - 2 * products, 0)

    def _reached(self) -> np.ndarray:
        seen = np.zeros(len(self.keys) + 1, bool)
        new = np.array([self.entry])
        while len(new):
            seen[new] = True
            new = np.unique(self.near[new])
            new = new[(new < len(self.keys)) & ~seen[new]]
        return np.flatnonzero(seen[:-1])

    def search(self, q: np.ndarray, wide: int, k: int) -> list[tuple[dict[int, float], int] | None]:
        """(scores of nodes that hold the ``k`` best, nodes scored) of each query; None where equal scores leave it to ``beam``."""
        if wide >= len(self.keys):
            # nothing is ever left out, so all that can be reached is scored
            found = self._reached()
            self._load(found)
            score = METRICS[self.name].scores(q, self.x[found])
            at, seen = np.broadcast_to(found, score.shape), np.full(len(q), len(found))
            tied = np.zeros(len(q), bool)
        else:
            score, at, seen, tied = self._beams(unit(q) if self.name == "cosine" else q, wide)
        if score.shape[1] > k:
            least = np.round(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], 6)
        else:
            least = np.full(len(q), -np.inf)
        kept = (np.round(score, 6) >= least[:, None]) & (score > -np.inf)
        return [
            None if tie else ({self.keys[i]: s for i, s in zip(a[own].tolist(), row[own].tolist())}, int(n))
            for row, a, own, n, tie in zip(score, at, kept, seen, tied)
        ]

    def _beams(self, q: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        count, n = len(q), len(self.keys)
        passed = np.zeros((count, n + 1), bool)
        passed[:, n] = passed[:, self.entry] = True
        # the best ``wide`` of each query, best first; -inf where there are fewer
        score, at, done = np.full((count, wide), -np.inf), np.full((count, wide), n), np.ones((count, wide), bool)
        score[:, 0] = self._scores(q, np.arange(count), np.full(count, self.entry))
        at[:, 0], done[:, 0] = self.entry, False
        seen, lost = np.ones(count, np.int64), np.full(count, -np.inf)
        going = np.arange(count)
        while len(going):
            first = np.argmin(done[going], axis=1)
            left = ~done[going, first]
            going, first = going[left], first[left]
            if not len(going):
                break
            done[going, first] = True
            near = self.near[at[going, first]]
            fresh = ~passed[going[:, None], near]
            passed[going[:, None], near] = True
            seen[going] += fresh.sum(axis=1)
            row, column = fresh.nonzero()
            if not len(row):
                continue
            new = np.full(near.shape, -np.inf)
            new[row, column] = self._scores(q, going[row], near[row, column])
            some = fresh.any(axis=1).nonzero()[0]
            own = going[some]
            every = np.hstack([score[own], new[some]])
            places, over = np.hstack([at[own], near[some]]), np.hstack([done[own], ~fresh[some]])
            order = np.argsort(-every, axis=1)
            best_ = np.take_along_axis(every, order, 1)
            # ties go to smaller nodes
            for i in ((best_[:, 1:] == best_[:, :-1]) & (best_[:, 1:] > -np.inf)).any(axis=1).nonzero()[0]:
                order[i] = np.lexsort((places[i], -every[i]))
            over = np.take_along_axis(over, order, 1)
            score[own], at[own], done[own] = best_[:, :wide], np.take_along_axis(places, order[:, :wide], 1), over[:, :wide]
            lost[own] = np.maximum(lost[own], np.where(over[:, wide:], -np.inf, best_[:, wide:]).max(axis=1))
        # a node that was put out by one of the same score would still be followed
        return score, at, seen, (lost == score[:, -1]) & (lost > -np.inf)


def _search(
    name: str,
    k: int,
    complexity: int,
    beam_width: int,
    mode: tuple[str, str] | None,
    prune_ratio: float,
    strategy: str,
    books: list[np.ndarray] | None,
    stop_early: bool,
    graph: pa.Table,
    queries: pa.Table
) -> pa.Table:
    measure = METRICS[name]
    nodes = graph["node"].to_numpy()
    place = {int(v): i for i, v in enumerate(nodes)}
    edges = graph["neighbors"].to_pylist()
    levels = graph["level"].to_numpy()
    rows: list[tuple] = []
    # any row of a group can be filtered away; the smallest id that is left stands for it
    members: dict[int, list[int]] = {}
    for v, level, near in sorted(zip(nodes.tolist(), levels.tolist(), edges)):
        members.setdefault(near[0] if level < 0 else v, []).append(v)
    held = {key: group[0] for key, group in members.items()}
    copies = {group[0]: group[:k] for group in members.values()}

    def near(v: int) -> list[int]:
        at = place[v]
        return [held[w] for w in edges[at][1 if levels[at] < 0 else 0 :] if w in held]

    if len(nodes) and len(queries):
        entry = int(nodes[np.argmax(levels)])
        entry = held[edges[place[entry]][0]] if levels[place[entry]] < 0 else held[entry]
        stored = None if mode else as_matrix(graph["embedding"].combine_chunks())
        texts = graph["text"] if mode else None
        coded = decode(books, as_matrix(graph["codes"].combine_chunks())) if prune_ratio > 0 else None
        # a node is embedded when a query of this task first visits it
        cache: dict[int, np.ndarray] = {}

        def vectors(wanted: list[int]) -> np.ndarray:
            if stored is not None:
                return stored[[place[v] for v in wanted]]
            fresh = [v for v in wanted if v not in cache]
            if fresh:
                cache.update(zip(fresh, EMBEDDERS[mode[0]]([texts[place[v]].as_py() for v in fresh], mode[1])))
            return np.array([cache[v] for v in wanted], float)

        def one(q: np.ndarray) -> tuple[dict[int, float], int]:
            def score(wanted: list[int]) -> np.ndarray:
                return measure.scores(q[None, :], vectors(wanted))[0]

            def by_codes(wanted: list[int]) -> np.ndarray:
                return measure.scores(q[None, :], coded[[place[v] for v in wanted]])[0]

            choose = chooser(strategy, prune_ratio, by_codes) if prune_ratio > 0 else None
            return beam(entry, near, score, wide, beam_width, choose, stop_early)

        wide = max(complexity, k)
        keys = sorted(copies)
        at_once = prune_ratio <= 0 and (wide >= len(keys) or (beam_width == 1 and stop_early))
        walk = _Walk(name, keys, [near(v) for v in keys], entry, vectors) if at_once else None
        qids, asked = queries["qid"].to_pylist(), as_matrix(queries["embedding"].combine_chunks())
        for low in range(0, len(qids), QUERIES_PER_SLICE):
            part = asked[low : low + QUERIES_PER_SLICE]
            for qid, q, found in zip(qids[low:], part, walk.search(part, wide, k) if at_once else (None,) * len(part)):
                top, scored = one(q) if found is None else found
                # ties go to smaller ids by the score that is returned
                best = sorted(((w, round(s, 6) + 0.0) for v, s in top.items() for w in copies[v]), key=lambda p: (-p[1], p[0]))[:k]
                rows += [(qid, v, s, scored) for v, s in best]
    return pa.table(
        {
            "qid": pa.array([r[0] for r in rows], pa.int64()),
            "id": pa.array([r[1] for r in rows], pa.int64()),
            "score": pa.array([r[2] for r in rows], pa.float64()),
            "visited": pa.array([r[3] for r in rows], pa.int64())
        }
    )


def routes(graph: DataFrame, queries: DataFrame, probes: int, metric_name: str, shards: int, query_rows: int) -> DataFrame:
    """(qid, shard): the ``probes`` shards whose means score best with each query."""
    means = graph.where("level = 1").select(F.col("shard").cast("long").alias("id"), F.col("centre").alias("embedding"))
    near = exact_top_k(means, queries, probes, metric_name, shards, query_rows)
    return near.select("qid", F.col("id").cast("int").alias("shard"))


def search(
    graph: DataFrame,
    data: DataFrame | None,
    queries: DataFrame,
    k: int = 5,
    metric_name: str = "mips",
    complexity: int = 64,
    beam_width: int = 1,
    recompute: tuple[str, str] | None = None,
    is_pruned: bool = False,
    prune_ratio: float = 0.0,
    strategy: str = "global",
    stop_early: bool = True,
    query_rows: int | None = None,
    rows: int | None = None,
    probes: int | None = None,
    books: list[np.ndarray] | None = None,
) -> DataFrame:
    """(qid, id, score, visited, rank): visited is how many nodes of the shard were scored for the query.

    data: (id, embedding), or (id, text) when vectors are recomputed with ``recompute`` = (mode, model); None if ``graph`` is a stored layout that holds
    them.  rows and query_rows: how many nodes and queries there are, where that is known; a graph that isn't written yet would be built once more
    to count them.  probes: in how many shards each query is searched; by default in 8, or twice the root of their number if that is more.
    prune_ratio drops a share of the neighbours by their codes (``strategy``), so it needs codes in the layout and ``books``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown pruning strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if recompute is None and is_pruned:
        raise RuntimeError("a pruned index has no vectors: search it with recomputation")
    if prune_ratio > 0 and (books is None or "codes" not in graph.columns):
        raise ValueError("prune_ratio needs the codes of an index that was built with them")
    payload = "text" if recompute else "embedding"
    if data is not None:
        graph = graph.join(data.select(F.col("id").alias("node"), payload), "node")
    held = graph.select("shard", "node", "level", "neighbors", payload, *(["codes"] if prune_ratio > 0 else []))
    name = metric(metric_name).name
    n_queries = queries.count() if query_rows is None else query_rows
    last = graph.agg(F.max("shard")).first()[0] if rows is None else shard_bound(rows) - 1
    shards = (last if last is not None else -1) + 1
    probes = max(8, int(2 * shards**0.5)) if probes is None else probes
    asked = queries.select("qid", F.col("embedding").cast("array<float>").alias("embedding"))
    if shards <= probes:
        blocks = max(1, -(-n_queries // QUERIES_PER_BLOCK))
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        asked = asked.withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>"))
        )
    else:
        routed = routes(graph, asked, probes, name, shards, n_queries)
        # a row for each shard that is asked: how many blocks its queries take
        busy = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("blocks"))
        held = held.join(
            F.broadcast(busy) if shards <= BROADCAST_SHARDS else busy, "shard"
        ).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        asked = asked.join(routed, "qid").join(
            F.broadcast(busy) if shards <= BROADCAST_SHARDS else busy, "shard"
        ).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")

    def run(nodes, asking):
        return _search(name, k, complexity, beam_width, recompute, prune_ratio, strategy, books, stop_early, nodes, asking)

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        run, "qid long, id long, score double, visited long"
    )
    return ranked(found.withColumn("score", F.round("score", 6)), k)


def tuned(
    graph: DataFrame,
    data: DataFrame,
    asked: DataFrame,
    golden: DataFrame,
    k: int,
    rows: int,
    metric_name: str = "mips",
    complexity: int = 128,
    share: float = 0.99,
    least: float = 0.97
) -> dict[str, int]:
    """probes and complexity for ``search`` of a written graph, by some queries ``asked`` whose exact hits ``golden`` (qid, id) are known.

    probes: the fewest shards, in the order that a query asks them, that hold ``share`` of the golden hits, and no fewer than by default.
    complexity doubles until the mean recall is ``least``, or a shard is searched whole.
    """
    shards, queries = shard_bound(rows), asked.count()
    means = graph.where("level = 1").select(F.col("shard").cast("long").alias("id"), F.col("centre").alias("embedding"))
    near = exact_top_k(means, asked, shards, metric_name, shards, queries).select("qid", F.col("id").cast("int").alias("shard"), "rank")
    held = golden.select("qid", F.col("id").alias("node")).join(graph.select("node", "shard"), "node").join(near, ["qid", "shard"])
    # a row for each rank: no more than there are shards
    ranks = sorted((r["rank"], r["n"]) for r in held.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect())
    total, within, probes = sum(n for _, n in ranks), 0, max(8, int(2 * shards**0.5))
    for rank, n in ranks:
        if within < share * total:
            probes = max(probes, rank)
        within += n
    while True:
        hits = search(graph, data, asked, k, metric_name, complexity, rows=rows, query_rows=queries, probes=probes)
        found = hits.join(golden, ["qid", "id"], "left_semi").count()
        if found >= least * total or complexity >= ROWS_PER_SHARD:
            return {"probes": probes, "complexity": complexity}
        complexity = min(2 * complexity, ROWS_PER_SHARD)


def compact(graph: DataFrame) -> DataFrame:
    """(shard, node, level, degree, pointer, neighbors): adjacency without padding (negative neighbours); pointer is where a node's neighbours begin
    in its shard's list, in order of node."""
    kept = graph.select("shard", "node", "level", F.filter("neighbors", lambda n: n >= 0).alias("neighbors")).withColumn(
        "degree", F.size("neighbors").cast("long")
    )
    # a shard holds a bounded number of nodes
    before = Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return kept.select("shard", "node", "level", "degree", F.coalesce(F.sum("degree").over(before), F.lit(0)).alias("pointer"), "neighbors")


def check_compact(rows: DataFrame) -> dict[str, int]:
    """Counts of what is wrong with a compact graph: pointers that don't follow one another, neighbours that are padding, not in the
    shard, or the node itself, repeated nodes, and shards without exactly one entry point."""
    order = Window.partitionBy("shard").orderBy("node")
    follows = F.lead("pointer").over(order)
    placed = rows.withColumn("_next", follows).withColumn("_first", F.row_number().over(order) == 1)
    wrong = placed.agg(
        F.count_if((F.col("_next") != F.col("pointer") + F.col("degree")) | (F.col("_first") & (F.col("pointer") != 0))).alias("pointers"),
        F.count_if(F.exists("neighbors", lambda n: n < 0) | (F.size("neighbors") != F.col("degree"))).alias("padding"),
        F.count_if(F.array_contains("neighbors", F.col("node"))).alias("loops"),
    ).first()
    edges = rows.select("shard", F.explode("neighbors").alias("node"))
    foreign = edges.join(rows.select("shard", "node"), ["shard", "node"], "left_anti").count()
    repeated = rows.groupBy("shard", "node").count().where("count > 1").count()
    entries = rows.groupBy("shard").agg(F.count_if(F.col("level") == 1).alias("n")).where("n != 1").count()
    return {**wrong.asDict(), "foreign": foreign, "repeated": repeated, "entries": entries}


def partitions(graph: DataFrame) -> DataFrame:
    """(shard, nodes, edges, inside) of each shard: its nodes, its edges, and the share of them that stay in it."""
    own = graph.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes"))
    edges = graph.select("shard", F.explode("neighbors").alias("node")).join(
        graph.select(F.col("shard").alias("other"), "node"), "node", "left"
    )
    return own.join(
        edges.groupBy("shard").agg(
            F.count(F.lit(1)).alias("edges"), F.avg((F.col("other") == F.col("shard")).cast("double")).alias("inside")
        ),
        "shard",
        "left"
    )
