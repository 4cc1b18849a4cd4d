"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct two-word shingles.  Its signature has 32 MinHash symbols of 16 bits, held
in eight chunks of four.  Two signatures that differ in at most 15 symbols agree, by pigeonhole, in at least three symbols of some
chunk; the allowed single error of a chunk is enumerated by leaving out each symbol in turn, so every document
has 8 * 4 keys.  Two sets of Jaccard similarity 0.8 share none of them with a probability of 1.1e-6, and are taken for more
than 18 symbols apart, beyond which none is compared, with one of 1.2e-6.

Candidates are never all pairs of a bucket.  First, each member of a bucket is compared with the bucket's leader
(its smallest id), which settles groups of copies of any size in linear work.  Then only members outside the leader's
component are compared with the other components in the bucket, after exact bounds: set sizes, and the
triangle inequality on the Jaccard distances to the leader.  Every link is confirmed on the full sets of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.common import hot_join, hot_keys, materialise, read, salted_lookup

SYMBOLS, CHUNKS, PER_CHUNK = 32, 8, 4
MAX_DISTANCE = 18
PARTNERS_PER_TASK = 512
_STREAM = np.random.Generator(np.random.PCG64(20240229))
_A = _STREAM.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _STREAM.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return text.lower().split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The distinct two-word shingles; of a single word, that word."""
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


class _Hashes(dict):
    """64-bit hashes of words, kept while there are at most ``LIMIT``."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def _set_hashes(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(_mix(_mix(h[:-1] + _MIX1) * _MIX1 + h[1:])) if len(h) > 1 else _mix(h ^ _MIX3)


def signature(elements: np.ndarray) -> np.ndarray:
    """32 symbols of 16 bits as eight 64-bit chunks."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 4096):
        np.minimum(low, (elements[at : at + 4096, None] * _A + _B).min(axis=0), out=low)
    symbols = (_mix(low) >> np.uint64(48)).reshape(CHUNKS, PER_CHUNK)
    shifts = np.array([48, 32, 16, 0], np.uint64)
    return np.bitwise_or.reduce(symbols << shifts, axis=1).view(np.int64)


SKETCH = "node long, n_shingles long, set_hi long, set_lo long, sig array<long>, doc_id long"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        n, keys, sigs = [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            if words:
                elements = _set_hashes(words, hashes)
                n.append(len(elements))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), np.int64))
                sigs.append(signature(elements))
            else:
                n.append(0)
                keys.append((None, None))
                sigs.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sigs, pa.list_(pa.int64())), batch.column(2)],
            ["node", "n_shingles", "set_hi", "set_lo", "sig", "doc_id"],
        )


def _keys(sig: str) -> Column:
    """The 32 keys: each chunk without each of its symbols, marked by chunk and place."""
    keys = []
    for c in range(CHUNKS):
        for p in range(PER_CHUNK):
            low = 16 * (PER_CHUNK - 1 - p)
            under = f"({sig}[{c}] & {(1 << low) - 1}L)"
            over = f"shiftleft(shiftrightunsigned({sig}[{c}], {low + 16}), {low})" if low < 48 else "0L"
            keys.append(f"({over} | {under} | {(c * PER_CHUNK + p) << 48}L)")
    return F.expr(f"array({', '.join(keys)})")


def _distance(a: str, b: str) -> Column:
    """In how many of the 32 symbols two signatures differ."""
    return F.expr(
        " + ".join(f"if(shiftleft({a}[{c}] ^ {b}[{c}], {up}) & {-(1 << 48)}L = 0, 0, 1)" for c in range(CHUNKS) for up in (0, 16, 32, 48))
    )


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, inter, total, sure) of the distinct, written pairs (a, b), on the full sets of words.

    Texts go to tasks by b.  A b with many partners is spread over salts, and its own text goes to each of them.
    """
    total = pairs.count()
    many = materialise(
        pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / PARTNERS_PER_TASK)), "partners"
    )
    hot = hot_keys(many, "b", "n", total)
    spread = hot_join(pairs, many.select("b", "salts"), "b", hot).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).select(
        "b", "salt", F.col("a").alias("doc_id"), F.lit(False).alias("own")
    )
    own = many.select(
        "b",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.col("b").alias("doc_id"),
        F.lit(True).alias("own")
    )
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = hot_join(spread.unionByName(own), texts, "doc_id", hot.select(F.col("b").alias("doc_id")))
    ordered = rows.select("b", "salt", "own", "doc_id", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("own"))
    return ordered.mapInArrow(_compare, "a long, b long, inter long, total long, sure boolean")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sets = None, []
    for batch in batches:
        found: list[tuple[int, int, int, int, bool]] = []
        for b, salt, own, a, text in zip(*(column.to_pylist() for column in batch.columns)):
            if (b, salt) != at:
                at, sets = (b, salt), []
            mine = shingles(words_of(text))
            if own:
                sets.append(mine)
            elif mine:
                # ids that carry several texts count with the pair of texts that is most alike
                best = max(((i := len(mine & other)) / (u := len(mine) + len(other) - i), i, u) for other in sets) if sets else (0, 0, 1)
                # the distance to one of several sets bounds nothing
                found.append((a, b, best[1], best[2], len(sets) == 1))
        columns = list(zip(*found)) if found else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["a", "b", "inter", "total", "sure"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); component is the smallest id that it reaches.

    Alternating large and small stars; each round is written to the shared folder.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_lookup(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every u of large has a smaller v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, least, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        ).distinct()
        now = materialise(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, confirmed_links.

    threshold: linked where ``inter * threshold[1] >= total * threshold[0]``; at least 0.8 for the stated guarantee.
    confirmed_links: links between different texts that were confirmed with the document's class; they span its component.

    Null or empty text, or one of white space: n_shingles 0, linked with nothing.  Null doc_id: never linked;
    component_id is null and kept is true.  Repeated rows, and equal sets under several ids, form one class.  Rows that share an
    id are one document, linked by any of its texts; work is linear in its rows.  An empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    # Nodes are ids while these are unique, else numbered rows: a text is found by its node, however many texts an id has.
    shared = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    node = F.monotonically_increasing_id() if shared else F.col("doc_id")
    docs = docs.select(node.alias("node"), "text", "doc_id")
    if shared:
        docs = materialise(docs, "numbered")
    sketch = materialise(docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(_sketch, SKETCH), "sketch")
    docs = docs.where("doc_id is not null").select(F.col("node").alias("doc_id"), "text")
    held = sketch.where("doc_id is not null and n_shingles > 0")
    classes = materialise(
        held.groupBy("set_hi", "set_lo").agg(
            F.min(F.struct("doc_id", "node"))["node"].alias("id"), F.min("node").alias("first"), F.max("node").alias("last"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
        ),
        "classes"
    )
    several = classes.where("first != last").select("set_hi", "set_lo", "id")
    copies = salted_lookup(held.select("set_hi", "set_lo", "node"), several, ["set_hi", "set_lo"]).where("node != id").select(
        F.col("node").alias("a"), F.col("id").alias("b")
    ).distinct()
    if shared:
        # the rows of an id are one document
        least = held.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b != last").drop("last")
        same = salted_lookup(held.select("doc_id", F.col("node").alias("a")), least, ["doc_id"]).where("a != b").select("a", "b")
        copies = copies.unionByName(same)

    keys = classes.select("id", F.explode(_keys("sig")).alias("key"))
    buckets = keys.groupBy("key").agg(
        F.min("id").alias("leader"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members")
    ).where("leader != last").drop("last")
    n_keys = CHUNKS * PER_CHUNK * classes.count()
    members = materialise(
        hot_join(keys, buckets, "key", hot_keys(buckets, "key", "members", n_keys)).select("key", "id", "leader", "members"), "members"
    )
    n_members = members.count()

    sizes = classes.select("id", "n", "sig")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs within the signature distance whose sizes allow the threshold, written."""
        pairs = materialise(pairs, "pairs")
        many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("w"))
        hot = hot_keys(many, "b", "w", pairs.count())
        ours, theirs = sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), sizes.select(
            F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")
        )
        out = hot_join(pairs.join(ours, "a"), theirs, "b", hot)
        fits = F.least("na", "nb") * threshold[1] >= F.greatest("na", "nb") * threshold[0]
        return materialise(out.where(fits & (_distance("sa", "sb") <= MAX_DISTANCE)).select("a", "b").distinct(), "close")

    is_link = F.col("inter") * threshold[1] >= F.col("total") * threshold[0]
    first = materialise(
        _verify(close(members.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()), docs),
        "verified"
    )
    links = first.where(is_link).select("a", "b")
    label = materialise(components(links.unionByName(copies)), "labels")

    # Buckets with more than two members of which some lie outside the leader's component.
    crowd = members.where("members > 2")
    named = crowd.join(label, "id", "left").select("key", "id", "leader", F.coalesce("component", "id").alias("comp"))
    led = crowd.groupBy("leader").agg(F.count(F.lit(1)).alias("w"))
    outside = hot_join(
        named,
        label.select(F.col("id").alias("leader"), F.col("component").alias("leads")),
        "leader",
        hot_keys(led, "leader", "w", n_members),
        how="left"
    )
    outside = outside.withColumn("out", F.col("comp") != F.coalesce("leads", "leader"))
    apart = F.when(F.col("sure"), 1 - F.col("inter") / F.col("total")).alias("d")
    outside = materialise(
        outside.join(first.select(F.col("a").alias("id"), F.col("b").alias("leader"), apart), ["id", "leader"], "left").select(
            "key", "id", "leader", "comp", "out", "d"
        ),
        "outside"
    )
    open_ = outside.groupBy("key").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all")).where("n_out > 0")
    salts = materialise(open_.select("key", "n_all", F.ceil(F.col("n_all") / 2048).alias("salts")), "open")
    hot = hot_keys(salts, "key", "n_all", n_members)
    far = 1 - threshold[0] / threshold[1] + 1e-9
    left = hot_join(outside.where("out and id != leader"), salts, "key", hot).select(
        "key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.col("id").alias("x"),
        F.col("comp").alias("cx"),
        F.col("d").alias("dx")
    )
    right = hot_join(outside.where("id != leader"), salts, "key", hot).select(
        "key",
        F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"),
        F.col("id").alias("y"),
        F.col("comp").alias("cy"),
        F.col("d").alias("dy"),
        "out"
    )
    apart = (F.col("cx") != F.col("cy")) & (~F.col("out") | (F.col("x") < F.col("y"))) & F.coalesce(
        F.abs(F.col("dx") - F.col("dy")) <= far, F.lit(True)
    )
    rest = left.join(right, ["key", "salt"]).where(apart).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    second = materialise(_verify(close(rest), docs), "verified")
    every = first.unionByName(second).where(is_link).select("a", "b").distinct()
    more = second.where(is_link).select("a", "b")
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    if shared:
        ids = held.select(F.col("node").alias("id"), "doc_id")
        # a component's smallest node, which has no label, may be a row of any of its ids
        nodes = label.unionByName(label.select(F.col("component").alias("id"), "component").distinct())
        placed = materialise(nodes.join(ids, "id").select("doc_id", "component").distinct(), "placed")
        least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
        label = salted_lookup(placed, least, ["component"]).select(F.col("doc_id").alias("id"), F.col("least").alias("component"))
        for end in ("a", "b"):
            every = salted_lookup(every, ids.select(F.col("id").alias(end), F.col("doc_id").alias("_id")), [end]).drop(end).withColumnRenamed("_id", end)
        every = every.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    degree = every.select(F.col("a").alias("id")).unionByName(every.select(F.col("b").alias("id"))).groupBy("id").agg(
        F.count(F.lit(1)).alias("confirmed_links")
    )
    linked = label.join(degree, "id", "left").select(F.col("id").alias("doc_id"), "component", "confirmed_links")
    out = sketch.select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("confirmed_links", F.lit(0).cast("long")).alias("confirmed_links")
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("confirmed_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_near_dedup": op1_near_dedup}

_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) ELSE w END AS s FROM w
), u AS (
  SELECT doc_id, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 80 * (len(sa.s) + len(sb.s) - i)
), f AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT f.b, r.c FROM r JOIN f ON f.a = r.a
), c AS (
  SELECT a, min(c) AS c FROM r GROUP BY a
), g AS (
  SELECT a, count(*) AS k FROM f GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON c.a = doc_id
"""
ORACLES: dict[str, str] = {"op1_near_dedup": _ORACLE}
