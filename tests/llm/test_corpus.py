"""Operators on the whole corpus, and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vectrine.llm import exact_topk, mixing, near_dedup, packing, quality_model, quality_rules, sharding
from vectrine.llm.common import materialise, shared_dir


def test_sharding_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op2_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(rows) == sorted(sharding.op2_sharding(spark, sf).collect())


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_sharding_of_odd_rows(spark, odd, none, tmp_path, per_bucket):
    held = materialise(odd, "odd")
    sharding.write_shards(held, str(tmp_path / "s"), 5, per_bucket=per_bucket)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert set(out.columns) == {*odd.columns, "slot"}
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["_place"], r["bucket"], r["row"], r["place"])
    assert Counter(map(key, out.collect())) == Counter(map(key, held.collect()))
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    sharding.write_shards(materialise(none, "none"), str(tmp_path / "n"), 5)


def test_permutation_is_uniform():
    first = Counter(int(sharding.fisher_yates(4, 1, b)[0]) for b in range(4000))
    assert all(abs(first[i] - 1000) < 150 for i in range(4))
    assert sorted(sharding.fisher_yates(50, 1, 2)) == list(range(50))
    assert list(sharding.fisher_yates(50, 1, 2)) == list(sharding.fisher_yates(50, 1, 2))


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by pouring again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        free = total - sum(full.values())
        target = {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return {**full, **target}
        full.update({s: cap * sizes[s] for s in over})


def check_mix(rows, max_epochs=3):
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] <= max_epochs * r["size"]
    aims = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aims[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= longest[s] / 2 + 1e-6


def test_mixing_query(spark, sf, duck, same_rows):
    same_rows(mixing.op6_mixing(spark, sf), mixing.ORACLES["op6_mixing"], duck)
    check_mix(mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_mixing_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    check_mix(rows)
    sizes = {(r["doc_id"], r["source"]): r["size"] for r in rows}
    assert sizes[3, "a"] == sizes[4, "b"] == sizes[7, "c"] == 0 and sizes[5, "b"] == 1
    again = mixing.repeat(odd)
    assert again.columns == odd.columns and again.count() == sum(r["times"] for r in rows)
    assert mixing.repeat(none).count() == 0
    blank = odd.where("text is null or doc_id in (3, 4)")
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mixing.mix(blank).collect())


def test_mixing_of_a_hot_source(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(1 + id % 13 as int))").alias("text"),
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, "tiny").otherwise(
            F.concat(F.lit("s"), F.col("id") % 7)
        ).alias("source")
    )
    check_mix(mixing.mix(docs).collect())


def test_mixing_of_a_hot_id(spark):
    """A third of all rows under one id, most of them equal; a third without an id."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 6 == 0, "the same words in each of them").otherwise(F.expr("repeat('w ', cast(1 + id % 13 as int))")).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
    )
    rows = mixing.mix(docs).collect()
    check_mix(rows)
    held = mixing.repeat(docs).collect()
    assert len(held) == sum(r["times"] for r in rows)
    words = Counter()
    for r in held:
        words[r["source"]] += len(r["text"].split())
    assert words == Counter({s: sum(r["taken"] for r in rows if r["source"] == s) for s in words})


def test_sizes(spark):
    texts = ["", " ", "a", " a  b\t\nc\x0b\x0cd\re ", "a b c", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["n"] for r in rows.select("i", mixing.size_of(F.col("text")).alias("n")).collect()}
    assert got == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op8_packing(spark, sf).collect()
    held = {(r["doc_id"], r["piece"]): r for r in rows}
    total = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, (start, length) in enumerate(packing.cut(len(ids))):
            p = held.pop((r["doc_id"], k))
            assert (p["start"], p["length"], p["ids_crc32"]) == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
    assert not held
    assert check_packing(rows, 2048) <= -(-total // 2048) + 1


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, 64, with_ids=True).collect()
    check_packing(rows, 64)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] in (3, 7)] == [[0], [0]]
    assert sum(r["doc_id"] == 1 and r["piece"] == 0 for r in rows) == 2
    assert packing.pack(none).count() == 0


def test_cuts_and_special_tokens():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]
    paths = packing.default_tokenizer()
    for text in ("plain words", "a <|endoftext|> b", "x" + " " * 30000 + "y", "é ß\n\n\n  ñ 12345 don't", "a" * 5000):
        assert list(packing.encode(text, *paths)) == list(packing.encode(text, paths[0], None))


def test_ids_are_those_of_the_tokenizer():
    """Over all documents of the largest table, and over long texts of mixed scripts, symbols and white space."""
    import pyarrow.parquet as pq

    paths = packing.default_tokenizer()
    slow = packing._tokenizers(*paths)[0]
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    draw = np.random.default_rng(5)
    parts = [
        " ",
        "  ",
        "\n",
        "\t",
        "\r\n",
        "\u00a0",
        "\u2003",
        "a",
        "don't",
        "I'LL",
        "x9",
        "12345",
        "...",
        "!?",
        "é",
        "ß",
        "ñ",
        "日本",
        "привет",
        "\U0001f600",
        "\u200d",
        "\x00",
        "\u0301",
        "|",
        "<|endoftext|>",
        "<|endof",
        "_",
        "'s"
    ]
    texts += [
        "".join(parts[k] for k in draw.integers(0, len(parts), int(n))) for n in [
            *draw.integers(1, 60, 2000), *draw.integers(5_000, 60_000, 20)
        ]
    ]
    texts += [" " * n + "y" for n in (1, 19_999, 20_000, 300_000)]
    for at in range(0, len(texts), 500):
        want = slow.encode_batch_fast([t or "" for t in texts[at : at + 500]], add_special_tokens=False)
        assert all(packing.encode(t or "", *paths).tolist() == w.ids for t, w in zip(texts[at : at + 500], want))


def test_fullest_against_brute_force():
    from itertools import product

    draw = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(n): int(draw.integers(1, 4)) for n in draw.integers(1, 20, 4)}
        room = int(draw.integers(0, 40))
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(counts, c))) <= room)
        chosen = packing.fullest(counts, room, sorted(counts, reverse=True))
        assert sum(a * n for a, n in chosen) == best and all(n <= counts[a] for a, n in chosen)


def test_topk_query(spark, sf, duck, same_rows):
    same_rows(exact_topk.op10_exact_topk(spark, sf), exact_topk.ORACLES["op10_exact_topk"], duck)


@pytest.mark.parametrize("per_group, per_block", [(4096, 16384), (3, 17)])
def test_topk_on_odd_rows(spark, monkeypatch, per_group, per_block):
    monkeypatch.setattr(exact_topk, "QUERIES_PER_GROUP", per_group)
    monkeypatch.setattr(exact_topk, "ROWS_PER_BLOCK", per_block)
    draw = np.random.default_rng(3)
    rows = [(i, [float(v) for v in draw.normal(size=5) * (1 + i % 3)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [
        (None, [1.0] * 5),
        (300, None),
        (302, [1.0, None, 0.0, 0.0, 0.0]),
        (304, [float("nan")] * 5),
        (306, [float("inf")] * 5),
        (310, [1.0, 2.0]),
        (320, [0.5, 1.0]),
        (330, []),
        (0, rows[0][1])
    ]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    good = [
        (i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i,
        v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    got = defaultdict(list)
    for r in exact_topk.exact_top_k(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q, v in {(i, tuple(v)): (i, v) for i, v in good if i % 10 == 0}.values():
        hits = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
        if hits:
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    assert dict(got) == want
    assert exact_topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert exact_topk.exact_top_k(df, F.lit(False)).count() == 0


def test_topk_of_huge_components(spark):
    """Products beyond doubles' whole numbers are exact, those beyond a long become its ends; one id with many vectors fills no list."""
    rows = [
        (0, [1.0, 0.0]),
        (1, [600000.0, 0.0]),
        (2, [900000.0, 1.0]),
        (3, [float(2**40), 3.0]),
        (4, [1e30, 0.0]),
        (5, [-1e30, 1.0]),
        (6, [1e35, 0.0]),
        (7, [2.0**30 + 2.0**-8, 0.0])
    ]
    rows += [(50, [float(j), 1.0]) for j in range(9)] + [(100, [3e5, 2.5e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    whole = lambda v: [math.floor(256 * x) for x in v]
    want = []
    for q, v in rows:
        if q % 50 == 0:
            hits = sorted((-max(-top, min(top, sum(a * b for a, b in zip(whole(v), whole(w))))), i) for i, w in rows if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    assert sorted(map(tuple, exact_topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def test_topk_prunes(spark):
    """Vectors in far clusters: queries are copied only to blocks that can hold their neighbours, and results stay exact."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 8)) * 40
    x = (centres[np.arange(1500) % 12] + draw.normal(size=(1500, 8)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    score = whole[::50] @ whole.T
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()}
    for row, q in zip(score, range(0, 1500, 50)):
        hits = sorted((-int(s), i) for i, s in enumerate(row) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in hits]


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = docs.collect()
    got = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = materialise(stage(spark, df, sf), "stage")
        got[name] = df.collect()
        assert name == "packing" or df.columns == columns
    clean = []
    for r in held:
        lines = (r["text"] or "").split("\n")
        full = [line.encode() for line in lines if line.split()]
        bad = {line for line in full if quality_rules.line_fails(line, len(full) == 1)}
        m = quality_rules.measure((r["text"] or "").encode())
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0] and 100 * sum(len(line.split()) for line in full if line in bad) <= 50 * m[0]:
            text = "\n".join(line for line in lines if line.encode() not in bad)
            clean.append(Row(**{**r.asDict(), "text": text, "n_chars": len(text)}))
    # no line of a kept text fails
    for r in got["quality rules"]:
        full = [line for line in r["text"].encode().split(b"\n") if line.split()]
        assert not any(quality_rules.line_fails(line, len(full) == 1) for line in full)
    held = clean
    assert sorted(got["quality rules"]) == sorted(held)
    model = quality_model.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), lambda i: ~quality_model.held_out(i))
    held = [r for r in held if model.scores(np.array([quality_model.features((r["text"] or "").encode())]))[0] >= 0.5]
    assert sorted(got["quality classifier"]) == sorted(held)
    sets = {r["doc_id"]: near_dedup.shingles(near_dedup.words_of(r["text"].encode())) for r in held}
    root = {i: i for i in sets}
    for _ in range(len(root)):
        moved = False
        for a in sets:
            for b in sets:
                if root[b] < root[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a], moved = root[b], True
        if not moved:
            break
    held = [r for r in held if root[r["doc_id"]] == r["doc_id"]]
    assert sorted(got["near dedup"]) == sorted(held)
    copies = Counter(r["doc_id"] for r in got["mixing"])
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in held:
        n = len(r["text"].encode().split())
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], n)
        assert copies[r["doc_id"]] <= 3
    assert all(abs(taken[s] - aim) <= longest[s] / 2 + 1e-6 for s, aim in water(sizes).items())
    check_packing(got["packing"], 2048)
    assert Counter(r["doc_id"] for r in got["packing"] if r["piece"] == 0) == copies


def test_pipeline_on_odd_rows(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        check_packing(corpus_pipeline.run(spark, str(tmp_path / name)).collect(), 2048)


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
