import random

import pytest

from vectrine.llm import near_dedup as op


def brute(rows, share=(80, 100)):
    """component of each id, by all pairs of full sets."""
    sets = {}
    for i, text in rows:
        if i is not None and (s := op.shingles(op.words_of((text or "").encode()))):
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(share[1] * len(x & y) >= share[0] * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def near(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Chains, stars, a hot group of near copies, documents around the threshold that share a passage, and unlike ones."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    hot = [draw.choice(vocabulary) for _ in range(120)]
    for _ in range(250):
        rows.append((i := i + 1, near(draw, hot, draw.randrange(0, 9))))
    chain = [draw.choice(vocabulary) for _ in range(150)]
    for _ in range(25):
        chain = near(draw, chain, 4)
        rows.append((i := i + 1, chain))
    passage = [draw.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        rows.append((i := i + 1, passage + [draw.choice(vocabulary) for _ in range(draw.choice((4, 8, 15, 30)))]))
    for _ in range(150):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 90))]
        rows.append((i := i + 1, base))
        rows.append((i := i + 1, near(draw, base, draw.randrange(0, 1 + len(base) // 8))))
    draw.shuffle(rows)
    return [(k, " ".join(w)) for k, w in rows]


def test_against_all_pairs(spark, corpus):
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute(corpus)


def test_small_salts(spark, corpus, monkeypatch):
    monkeypatch.setattr(op, "PARTNERS_PER_TASK", 7)
    got = {
        r["doc_id"]: r["component_id"] for r in op.near_duplicates(
            spark.createDataFrame(corpus[:300], "doc_id long, text string")
        ).collect()
    }
    assert got == brute(corpus[:300])


def test_several_texts_under_an_id_and_a_hot_leader(spark, monkeypatch):
    """The distance to one of several texts bounds nothing; a leader of a third of all documents is spread over tasks."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(100)]
    rows = [(1, near(draw, base, 3)), (1, [draw.choice(vocabulary) for _ in range(80)])]
    rows += [(2 + i, near(draw, base, draw.randrange(0, 16))) for i in range(120)]
    rows += [
        (
            500 + i // 2, near(draw, base, draw.randrange(5, 20)) if i % 3 else [draw.choice(vocabulary) for _ in range(90)]
        ) for i in range(80)
    ]
    rows += [(900 + i, [draw.choice(vocabulary) for _ in range(50)]) for i in range(100)]
    rows = [(k, " ".join(w)) for k, w in rows]
    monkeypatch.setattr(op, "PARTNERS_PER_TASK", 16)
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_many_texts_under_one_id(spark, monkeypatch):
    """A third of all rows under one id, with texts of their own, repeated rows and a near copy under other ids: no text meets all texts of that id."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(5, words(i)) for i in range(400)] + [(5, words(0))] * 50
    rows += [(1000 + i, words(i) + f" tail{i}") for i in range(0, 400, 2)] + [(2000 + i, words(1000 + i)) for i in range(300)] + [(3, words(1001) + " end"), (None, words(1))]
    met = []
    whole = op._verify

    def counted(pairs, docs):
        ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
        met.append((docs.join(ids, "doc_id").count(), ids.count()))
        return whole(pairs, docs)

    monkeypatch.setattr(op, "_verify", counted)
    found = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == len(rows)
    want = {i: 5 for i in (5, *range(1000, 1400, 2))} | {2000 + i: 2000 + i for i in range(300)} | {3: 3, 2001: 3, None: None}
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(i, c, i == c) for i, c in want.items()}
    assert {r["confirmed_links"] for r in found if r["doc_id"] == 5} == {200}
    assert met and all(texts == ids for texts, ids in met)


def test_odd_rows(odd, none):
    found = op.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want.get(r["doc_id"], r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in found if r["doc_id"] in (3, 4, 5, 7)} == {3: 0, 4: 0, 5: 1, 7: 0}
    assert op.near_duplicates(none).count() == 0


def test_query_matches_sql(spark, sf, duck, same_rows):
    same_rows(op.op1_near_dedup(spark, sf), op.ORACLES["op1_near_dedup"], duck)


def test_pigeonhole(spark):
    """Signatures that differ in up to 15 symbols share a key."""
    draw = random.Random(2)
    from pyspark.sql import functions as F

    rows = []
    for n in range(60):
        a = [draw.randrange(1 << 16) for _ in range(32)]
        b = list(a)
        for at in draw.sample(range(32), 15):
            b[at] ^= 1 + draw.randrange(65535)
        pack = lambda s: [int.from_bytes(b"".join(v.to_bytes(2, "big") for v in s[c : c + 4]), "big", signed=True) for c in range(0, 32, 4)]
        rows.append((n, pack(a), pack(b)))
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    out = df.select(F.arrays_overlap(op._keys("a"), op._keys("b")).alias("shared"), op._distance("a", "b").alias("d")).collect()
    assert all(r["shared"] and r["d"] == 15 for r in out)
