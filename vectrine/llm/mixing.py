"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the whole.  A source may be used ``max_epochs`` times at most; what it can't give is
shared again among the others by weight until none is above its cap.  A source with a target of ``e`` times its size gives every document
``floor(e)`` times, and a seeded choice of its documents once more: those first by a seeded hash whose sizes add up to the fraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.llm.common import materialise, read, running, small_lookup

MAX_EPOCHS = 3
SEED = "mix-1"
CELLS = 4096


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, source_size).

    Sources are in order of code points, null last, and take ``weights`` in turn.  Those that fill up first have the smallest cap
    for their weight, so one pass over the sources in that order finds the level of the water.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = running(named, [F.col("last"), F.col("name")], {"place": F.lit(1).cast("long")}, ["source", "source_size", "last", "name"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    filled = ranked.select(
        "source", "source_size", "last", "name", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")
    )
    order = [F.col("cap") / F.col("weight"), F.col("last"), F.col("name")]
    keep = ["source", "source_size", "last", "name", "weight", "cap"]
    passed = running(filled, order, {"caps": F.col("cap"), "weights": F.col("weight")}, keep)
    # scalars: the words of all sources, and all weights
    words, weights_sum = (int(x or 0) for x in passed.agg(F.sum("source_size"), F.sum("weight")).first())
    # a source fills up if the level that its forerunners leave reaches its cap
    left = F.lit(words) - (F.col("caps") - F.col("cap"))
    share = F.lit(weights_sum) - (F.col("weights") - F.col("weight"))
    level = materialise(passed.withColumn("full", left * F.col("weight") >= F.col("cap") * share), "level")
    caps, full_weights = (int(x or 0) for x in level.where("full").agg(F.sum("cap"), F.sum("weight")).first())
    each = F.lit(float(words - caps) / float(weights_sum - full_weights) if weights_sum > full_weights else 0.0)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * each)
    return level.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """(row, _source, _key, _cell, size, _mark): the whole row in one column, so that no name of ``docs`` can clash."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    held = docs.select(
        F.struct("*").alias("row"), source.alias("_source"), key.alias("_key"), size_of(F.col("text")).alias("size"), mark.alias("_mark")
    )
    return held.withColumn("_cell", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))


def plan(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source of ``sizes`` (source, _source, _cell, size): source_size, target, whole repetitions, and the cell in which the rest ends.

    Cells before ``edge`` are taken once more, those after it are not; of the edge itself, ``rest`` words are wanted.
    """
    cells = materialise(sizes.groupBy("source", "_source", "_cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    aims = materialise(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("whole", F.least(whole, F.lit(max_epochs).cast("long")))
    aims = aims.withColumn(
        "wanted", F.when(F.col("whole") >= max_epochs, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    )
    aims = aims.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    # of a source there are 4,096 cells at most
    upto = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.select("_source", "_cell", "cell_size", F.sum("cell_size").over(upto).alias("after")).join(
        aims.select("_source", "wanted"), "_source"
    )
    # the first cell that isn't taken whole; none of the cells before it ends beyond what is wanted
    cut = placed.where((F.col("wanted") > 0) & (F.col("after") > F.col("wanted"))).groupBy("_source")
    edges = cut.agg(
        F.min_by(F.struct("_cell", (F.col("wanted") - (F.col("after") - F.col("cell_size"))).alias("rest")), "_cell").alias("e")
    )
    joined = aims.join(edges, "_source", "left")
    edge = F.when(F.col("wanted") <= 0, F.lit(-1)).otherwise(F.coalesce("e._cell", F.lit(CELLS)))
    rest = F.when(F.col("wanted") <= 0, F.lit(0.0)).otherwise(F.coalesce("e.rest", F.lit(0.0)))
    return materialise(joined.select("_source", "source_size", "target", "whole", edge.alias("edge"), rest.alias("rest")), "mix-plan")


def _times(keyed: DataFrame, aims: DataFrame) -> DataFrame:
    """``keyed`` rows with their source's plan and ``times``; only rows in the cell where a source's rest ends are put in order."""
    joined = small_lookup(keyed, aims, ["_source"])
    settled = joined.where("_cell != edge").withColumn("times", F.col("whole") + (F.col("_cell") < F.col("edge")).cast("long"))
    edge = materialise(joined.where("_cell = edge").withColumn("_tie", F.monotonically_increasing_id()), "mix-edge")
    # the last column only tells equal rows apart, of which any may be chosen
    order = [F.col("_key"), F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("size"), F.col("_mark"), F.col("_tie")]
    narrow = edge.select("_source", "_key", F.struct("row.doc_id").alias("row"), "size", "_mark", "_tie", "rest")
    upto = running(narrow, order, {"upto": F.col("size")}, ["_source", "_key", "row", "size", "_mark", "_tie", "rest"], ["_source"])
    extra = (F.col("rest") > 0) & (F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    chosen = edge.join(upto.select("_tie", extra.alias("_extra")), "_tie").withColumn(
        "times", F.col("whole") + F.col("_extra").cast("long")
    )
    return settled.unionByName(chosen.select(settled.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source) with size, source_size, target, taken (words) and times (repeats, 0 to ``max_epochs``).

    A source's taken words miss its target by half of one document at most.  Rows are chosen by the md5 of seed and id, then id, size and text, so reruns
    agree.  A source of a third of all rows is split into 4,096 cells by that hash; only the cell in which the fraction ends is
    put in order, in ranges that split rows of one id, and equal rows too.

    A null text has size 0 and is taken 0 times in words; a null source is a source of its own, last in order; a null id counts as an
    empty one.  Repeated rows are chosen one by one.  With no words at all every target is 0.  An empty table gives none.  Other columns are ignored.
    """
    narrow = _keyed(docs.select("doc_id", "text", "source"), seed)
    rows = materialise(
        narrow.select(F.struct("row.doc_id", "row.source").alias("row"), "_source", "_key", "size", "_mark", "_cell"), "mix-sizes"
    )
    aims = plan(rows.select("row.source", "_source", "_cell", "size"), weights, max_epochs)
    return _times(rows, aims).select(
        "row.doc_id", "row.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"
    )


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``mix`` takes it, with all columns; no shuffle over texts.

    ``docs`` is read twice.  Nulls, ties, repeated rows and empty tables count as in ``mix``; columns may have any names.
    """
    keyed = _keyed(docs, seed)
    aims = plan(keyed.select("row.source", "_source", "_cell", "size"), weights, max_epochs)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_copy")
    taken = _times(keyed, aims).where("times > 0").select("row", copies)
    return taken.select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_mixing": op6_mixing}

_ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS mark FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s
), t AS (
  SELECT *, sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weights,
    coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (whole - caps) * weight >= cap * (all_weights - weights) AS filled FROM t
), l AS (
  SELECT *, (whole - coalesce(sum(cap) FILTER (filled) OVER (), 0))::DOUBLE / (all_weights - coalesce(sum(weight) FILTER (filled) OVER (), 0))::DOUBLE AS level FROM f
), a AS (
  SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE weight::DOUBLE * level END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM a
), r AS (
  SELECT doc_id, size, source_size, target, epochs, CASE WHEN epochs >= 3 THEN 0.0 ELSE target - epochs * source_size END AS wanted,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size, mark ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN wanted > 0 AND upto - size / 2 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
ORACLES: dict[str, str] = {"op6_mixing": _ORACLE}
