import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectrine.functions import vector
from vectrine.operators import embed, graph, knn, pq


@pytest.fixture(scope="module")
def data(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").cache()


@pytest.fixture(scope="module")
def held_out(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "qid long, embedding array<float>")


def recall(found, golden):
    a = {(r["qid"], r["id"]) for r in found.collect()}
    b = {(r["qid"], r["id"]) for r in golden.collect()}
    return len(a & b) / len(b)


@pytest.mark.parametrize("metric", ["mips", "l2", "cosine"])
def test_graph_recall_on_queries_outside_the_index(data, held_out, metric):
    scaled = data.withColumn("embedding", F.expr("transform(embedding, x -> cast(x * (1 + id % 5) as float))"))
    found = graph.search(graph.build(scaled, metric), scaled, held_out, 10, metric)
    assert recall(found, knn.exact_top_k(scaled, held_out, 10, metric)) >= 0.95


def test_pq_recall(data, held_out):
    books = pq.train(data)
    assert recall(pq.search(data, pq.encode(data, books), books, held_out), knn.exact_top_k(data, held_out, 10)) >= 0.95


def test_recompute_visits_few_nodes(spark):
    docs = spark.range(300).select("id", F.concat(F.lit("document "), F.col("id"), F.lit(" about topic "), F.col("id") % 7).alias("text"))
    held = embed.embed(docs)
    asked = held.where("id < 5").select(F.col("id").alias("qid"), "embedding")
    built = graph.build(held, "cosine", 8, 32)
    found = graph.search(built, docs, asked, 3, "cosine", complexity=16, recompute=("hash", "64"), is_pruned=True).collect()
    assert all(r["id"] == r["qid"] for r in found if r["rank"] == 1)
    assert max(r["visited"] for r in found) < 300
    with pytest.raises(RuntimeError):
        graph.search(built, held, asked, 3, is_pruned=True)
    with pytest.raises(ValueError):
        graph.search(built, held, asked, 3, strategy="other")


@pytest.mark.parametrize("metric", ["mips", "l2", "cosine"])
def test_pq_on_large_tables_and_near_copies(spark, metric, monkeypatch):
    """More near copies of one vector than the shortlist holds: their codes tie, and the best of them lie outside it."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(6000, 64))
    x[5000:] = x[5000] + draw.normal(size=(1000, 64)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= draw.choice([0.5, 1, 2], size=6000)[:, None] if metric == "cosine" else 1
    y = np.concatenate([x[5000:5020] + draw.normal(size=(20, 64)) * 0.001, draw.normal(size=(20, 64))])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4).cache()
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "qid long, embedding array<float>").cache()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 25)
    monkeypatch.setattr(knn, "DATA_BLOCK", 2500)
    books = pq.train(data, rows=2000)
    codes = pq.encode(data, books).cache()
    golden = knn.exact_top_k(data, asked, 10, metric)
    assert recall(pq.search(data, codes, books, asked, metric_name=metric), golden) == 1
    # queries among near copies rule the rest of the table out
    close = asked.where("qid < 20").select("qid", "embedding").join(
        golden.where("rank = 10").select("qid", F.col("score").alias("least")), "qid"
    )
    assert pq.candidates(codes, books, close, metric, 6000, 20).count() < 3000
    assert recall(
        pq.search(data.limit(7), pq.encode(data.limit(7), books), books, asked, metric_name=metric),
        knn.exact_top_k(data.limit(7), asked, 10, metric)
    ) == 1


def test_graph_recall_beside_copies(spark, monkeypatch):
    """Parameters of graph_search_recompute; more copies of one text in each shard than a node has candidates."""
    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{w}" for w in draw.integers(0, 400, 30)) for _ in range(2000)] + ["one text that is found again and again"] * 1000
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "id long, text string").repartition(4).cache()
    monkeypatch.setattr(graph, "ROWS_PER_SHARD", 1000)
    held = embed.embed(docs).cache()
    asked = held.where("id % 20 = 0 and id < 2100").select(F.col("id").alias("qid"), "embedding")
    built = graph.build(held, "cosine", 16, 64, rows=3000).cache()
    assert built.count() == 3000 and built.groupBy("shard").agg(
        F.sum((F.col("level") < 0).cast("int")).alias("n")
    ).where("n > 200").count() >= 1

    def found(data):
        return graph.search(built, data, asked, 5, "cosine", complexity=32, recompute=("hash", "64"), is_pruned=True, rows=3000)

    golden = knn.exact_top_k(held, asked, 5, "cosine")
    assert recall(found(docs).where("qid < 2000"), golden.where("qid < 2000")) >= 0.9
    assert recall(found(docs).where("qid >= 2000"), golden.where("qid >= 2000")) == 1
    # the copies' own node is gone, the others are still found
    left = found(docs.where("id >= 2100")).where("qid >= 2000").collect()
    assert sorted({r["id"] for r in left}) == [2100, 2101, 2102, 2103, 2104]


def test_blocks_don_t_change_results(data, held_out, monkeypatch):
    whole = knn.exact_top_k(data, held_out, 7).collect()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "DATA_BLOCK", 60)
    assert sorted(knn.exact_top_k(data, held_out, 7).collect()) == sorted(whole)


def test_k_above_rows_ties_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [r["id"] for r in knn.exact_top_k(same, asked, 9).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert knn.exact_top_k(same.limit(0), asked, 3).count() == 0
    assert knn.exact_top_k(same, asked.limit(0), 3).count() == 0


def test_post_filter_stays_above_the_search(data, held_out):
    plan = knn.search(
        data.withColumn("label", F.col("id") % 3), held_out, 5, filters={"label": {"==": 1}}
    )._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("label") >= 0
    assert knn.search(data.withColumn("label", F.col("id") % 3), held_out, 5, filters={"label": {"==": 1}}).count() <= 5 * 40


def test_ranking_is_limited_early(data, held_out):
    assert "WindowGroupLimit" in knn.exact_top_k(data, held_out, 3)._jdf.queryExecution().executedPlan().toString()


def test_vectors():
    with pytest.raises(ValueError):
        vector.metric("other")
    assert vector.default_metric("text-embedding-3-small", "openai") == "cosine"
    assert vector.default_metric("facebook/contriever", "sentence-transformers") == "mips"


def test_embedders(spark):
    with pytest.raises(ValueError):
        embed.compute(["a"], mode="other")
    with pytest.raises(ValueError):
        embed.compute([" "])
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "id long, text string")
    assert [r["embedding"] is None for r in embed.embed(rows).orderBy("id").collect()] == [False, True, True]
    assert abs(np.linalg.norm(embed.compute(["a b c"])[0]) - 1) < 1e-6
    distances = embed.recomputed_distances(spark.createDataFrame([(1,), (9,)], "id long"), rows, [0.0] * 64).collect()
    assert {r["id"]: r["distance"] for r in distances}[9] == 1e9
    assert np.allclose(embed.pooled(np.array([[[1.0], [3.0]]]), np.array([[1, 0]])), [[1.0]])


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around many centres, as embeddings of texts are."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 32))
    x = centres[draw.integers(0, 60, 6000)] + draw.normal(size=(6000, 32)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4).cache()


@pytest.mark.parametrize("metric", ["mips", "l2", "cosine"])
def test_queries_go_to_few_shards(spark, clustered, monkeypatch, metric):
    monkeypatch.setattr(graph, "ROWS_PER_SHARD", 200)
    built = graph.build(clustered, metric, 16, 64, rows=6000).cache()
    info = graph.partitions(built).collect()
    assert len(info) >= 25 and sum(r["nodes"] for r in info) == 6000 and max(r["nodes"] for r in info) < 900
    assert all(r["inside"] in (None, 1.0) for r in info)
    asked = clustered.where("id % 60 = 0").select(F.col("id").alias("qid"), "embedding")
    held = graph.layout(built, clustered)
    found = graph.search(held, None, asked, 10, metric, rows=6000).cache()
    assert recall(found, knn.exact_top_k(clustered, asked, 10, metric)) >= 0.95
    # a query scores a part of the table only
    assert found.groupBy("qid").agg(F.max("visited").alias("v")).where("v > 900").count() == 0


def test_compact_graph(spark, clustered):
    rows = graph.compact(graph.build(clustered.where("id < 500"), "l2", 8, 32, rows=500)).cache()
    assert set(graph.check_compact(rows).values()) == {0}
    broken = rows.withColumn("pointer", F.when(F.col("node") == 7, -1).otherwise(F.col("pointer"))).withColumn(
        "neighbors", F.when(F.col("node") == 9, F.array(F.lit(9).cast("long"))).otherwise(F.col("neighbors"))
    )
    wrong = graph.check_compact(broken)
    assert wrong["pointers"] >= 1 and wrong["loops"] == 1 and wrong["padding"] == 1 and wrong["foreign"] == 0


@pytest.mark.parametrize("strategy", graph.STRATEGIES)
def test_pruning_by_codes(spark, clustered, strategy):
    some = clustered.where("id < 2000").cache()
    books = pq.train(some)
    held = graph.layout(graph.build(some, rows=2000), some, pq.encode(some, books)).cache()
    asked = some.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    golden = knn.exact_top_k(some, asked, 10)
    run = lambda ratio: graph.search(held, None, asked, 10, rows=2000, prune_ratio=ratio, strategy=strategy, books=books).cache()
    whole, pruned = run(0.0), run(0.5)
    visits = lambda hits: hits.agg(F.avg("visited")).first()[0]
    assert visits(pruned) < 0.8 * visits(whole)
    assert recall(whole, golden) >= 0.95 and recall(pruned, golden) >= 0.85
    with pytest.raises(ValueError):
        graph.search(held.drop("codes"), None, asked, 10, rows=2000, prune_ratio=0.5)


@pytest.mark.parametrize(
    "backend, options",
    [("graph", {"codes": True}), ("graph", {"is_recompute": False}), ("disk", {}), ("disk", {"is_recompute": False}), ("flat", {})]
)
def test_backends_on_disk(spark, sf, tmp_path, monkeypatch, backend, options):
    from vectrine import index

    monkeypatch.setenv("VECTRINE_HOME", str(tmp_path / "home"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        built = index.Builder(spark, backend, **options).add_documents(docs, "doc_id")
    where = f"file://{tmp_path}/i"
    m = built.build(where)
    assert (tmp_path / "i" / "embeddings").exists() != m.is_pruned
    asked = [r["text"] for r in docs.orderBy("doc_id").limit(5).collect()]
    hits = index.Searcher(spark, where).search(asked, 3).where("rank = 1").orderBy("qid").collect()
    assert [r["text"] for r in hits] == asked
    if options.get("codes"):
        assert index.Searcher(spark, where).search(asked, 3, prune_ratio=0.3, pruning_strategy="local").where("rank = 1").count() == 5
    if backend == "disk":
        with pytest.raises(NotImplementedError):
            index.Searcher(spark, where).search(asked, 3, pruning_strategy="proportional")
    with pytest.raises(FileExistsError):
        built.build(where)


def test_plug_in_backends(monkeypatch):
    from vectrine import index

    with pytest.raises(ValueError):
        index.found_backend("nowhere")
    with pytest.raises(TypeError):
        type("Half", (index.Backend,), {})()
    assert index.discover() == sorted(index.BACKENDS)


def test_memory_budgets():
    assert pq.memory_budget(0, 1, 1) == (0.1, 2.0)
    assert pq.memory_budget(50 * 2**30, 10, 100) == (5.0, 5.0) and pq.memory_budget(0, 90, 100) == (0.1, 45.0)
    assert pq.code_parts(64, None, 10) == 16 and pq.code_parts(64, 1.0, 2**27) == 8 and pq.code_parts(64, 0.1, 10) == 64


@pytest.mark.parametrize("name", ["graph_search", "graph_search_recompute"])
def test_a_search_reads_a_written_graph(spark, sf, name):
    """It needs the graph more than once: one that isn't written is built as often, and within the time of a broadcast."""
    from vectrine.plans import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("name,wide,early", [("mips", 24, True), ("l2", 24, True), ("cosine", 24, True), ("mips", 4096, False)])
def test_many_queries_walk_at_once(monkeypatch, name, wide, early):
    """Hits and visited nodes of a slice of queries are those of one beam for each; the shard holds copies, and rows were filtered away."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 8)).astype(np.float32)
    x[300:] = x[draw.integers(0, 10, 100)]
    kind = pa.list_(pa.float32())
    rows = pa.table({"id": np.arange(400) * 3, "embedding": pa.array(list(x), kind), "shard": pa.array([0] * 400, pa.int32())})
    built = graph._build(name, 8, 40, 1.2, rows)
    place = (built["node"].to_numpy() // 3).tolist()
    shard = built.append_column("embedding", pa.array([x[i] for i in place], kind)).take(draw.permutation(400)[:380])
    q = draw.normal(size=(300, 8)).astype(np.float32)
    q[:100] = x[300:]
    asked = pa.table({"qid": np.arange(300), "embedding": pa.array(list(q), kind)})

    def no_beam(*args):
        raise AssertionError("one query at a time")

    with monkeypatch.context() as m:
        m.setattr(graph, "beam", no_beam)
        found = graph._search(name, 5, wide, 1, None, 0.0, "global", None, early, shard, asked)
    monkeypatch.setattr(graph._Walk, "search", lambda self, part, *_: [None] * len(part))
    assert found.equals(graph._search(name, 5, wide, 1, None, 0.0, "global", None, early, shard, asked))


def test_recall_is_tuned_on_vectors_without_near_shards(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_PER_SHARD", 64)
    x = np.random.default_rng(5).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>").cache()
    asked = data.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    golden = knn.exact_top_k(data, asked, 10).select("qid", "id").cache()
    built = graph.build(data, "mips", 16, 64, rows=3000).cache()
    plain = graph.search(built, data, asked, 10, rows=3000, complexity=128)
    assert recall(plain, golden) < 0.95
    assert recall(graph.search(built, data, asked, 10, rows=3000, **graph.tuned(built, data, asked, golden, 10, 3000)), golden) >= 0.95
    books = pq.train(data, 4, 16)
    codes = pq.encode(data, books).cache()
    assert recall(pq.shortlist(codes, books, asked, 64, "mips", 3000), golden) < 0.95
    wide = pq.enough(codes, books, asked, golden, 64, "mips", 3000)
    assert recall(pq.shortlist(codes, books, asked, wide, "mips", 3000), golden) >= 0.95


def test_recomputed_passages_without_tokens(spark):
    """A passage with a blank or null text, or one whose counts cancel out, is found; SQL gives it distance 0 and length 1."""
    pair = next(f"t{i} t{j}" for i in range(99) for j in range(i) if not embed.hash_embed([f"t{i} t{j}"]).any())
    docs = spark.createDataFrame([(1, "a b"), (2, " \n"), (3, None), (4, pair)], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    q = [float(v) for v in embed.compute(["a b"])[0]]
    far = {r["id"]: round(r["distance"], 6) + 0.0 for r in embed.recomputed_distances(ids, docs, q).collect()}
    assert far == {1: -1.0, 2: 0.0, 3: 0.0, 4: 0.0, 9: 1e9}
    rows = {r["id"]: r for r in embed.recomputed(ids, docs, 64).collect()}
    assert {i: r["is_found"] for i, r in rows.items()} == {1: True, 2: True, 3: True, 4: True, 9: False}
    assert {i: round(float(np.linalg.norm(r["embedding"])), 5) for i, r in rows.items()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 9: 0.0}


def test_common_tokens_stay_among_many_rare_ones(monkeypatch):
    monkeypatch.setattr(embed._Buckets, "LIMIT", 10)
    embed._buckets.cache_clear()
    texts = ["common words " + " ".join(f"r{i}x{j}" for j in range(7)) for i in range(50)]
    first = embed.hash_embed(texts)
    held = embed._buckets(64)
    assert len(held) == 10 and {"common", "words"} <= set(held)
    assert np.array_equal(first, embed.hash_embed(texts))
    embed._buckets.cache_clear()
