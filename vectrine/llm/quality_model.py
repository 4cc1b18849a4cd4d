"""Quality by Bradley-Terry pairwise ranking.

Each pair (a document labelled 1, one labelled 0) is a preference.  The scores are linear in text statistics, fitted by the logistic
loss on feature differences over all pairs of all labelled rows.  The loss of a pair depends on the difference of two scores alone, so a
Newton step needs, of each label, the moments of the rows by narrow cells of score: work is linear in the rows, and what reaches the
driver is bounded by the cells.  Rows of a cell count with their cell's mean score; all sums are of whole numbers, so that reruns agree.
The threshold is a quantile of all labelled rows' scores: the one that separates their labels best.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.common import id_crc, materialise, read, salted_lookup
from vectrine.llm.learn import agreed
from vectrine.llm.quality_rules import repeated_words

#: Width of a cell of scores in a Newton step and for the threshold; a unit of the sums.
CELL, FINE, UNIT = 1 / 16, 1 / 256, 2.0**30
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_RUN = re.compile(rb"[!?*]{2}")
_ENDS = (b".", b"!", b"?", b'"', b")", "”".encode(), "»".encode(), "…".encode(), "。".encode())
FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "pipes",
    "runs",
    "upper",
    "digits",
    "repeated",
    "echoes",
    "distinct",
    "short_distinct",
    "dup_lines",
    "open_lines",
    "log_line_words",
    "one_word_lines",
    "commas",
    "stops"
)


def short_distinct(words: list[bytes], window: int = 100) -> float:
    """The mean share of distinct words in windows that follow one another and cover all words; the last one ends with the text."""
    n = len(words)
    if n <= window:
        return len(set(words)) / n
    starts = [*range(0, n - window, window), n - window]
    return sum(len(set(words[at : at + window])) for at in starts) / (window * len(starts))


def features(text: bytes) -> list[float]:
    """Statistics of a whole text; shares lie in 0 to 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [line.rstrip() for line in text.split(b"\n") if line.split()]
    k = len(lines)
    size = sum(map(len, words))
    upper = size - len(b"".join(words).translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(b"".join(words).translate(None, b"0123456789"))
    has_symbol = _SYMBOL.search(text) is not None
    return [
        float(np.log1p(n)) / 8,
        min(size / n, 30) / 10,
        min(1.0, sum(1 for w in words if _SYMBOL.search(w)) / n) if has_symbol else 0.0,
        min(1.0, text.count(b"|") / n),
        min(1.0, len(_RUN.findall(text)) / n),
        upper / size,
        digits / size,
        repeated_words(words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        short_distinct(words),
        1 - len(set(lines)) / k,
        sum(1 for line in lines if not line.endswith(_ENDS)) / k,
        float(np.log1p(n / k)) / 6,
        sum(1 for line in lines if len(line.split()) == 1) / k,
        min(1.0, text.count(b",") / n),
        min(1.0, text.count(b".") / n),
    ]


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8)

    def weighed(self, z: np.ndarray) -> np.ndarray:
        """One column after another, so that a row's sum doesn't depend on the rows beside it."""
        return sum((z[:, k] * w for k, w in enumerate(self.weights)), np.zeros(len(z)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weighed(self.scaled(x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(text.as_py() or b"") for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


_WIDTH = 1 + len(FEATURES) + len(FEATURES) * (len(FEATURES) + 1) // 2
_UPPER = np.triu_indices(len(FEATURES))


def _added(keys: np.ndarray, sums: np.ndarray, into: dict[tuple[int, int], np.ndarray]) -> None:
    """Adds ``sums`` of rows (or parts) with the same key."""
    order = np.lexsort(keys.T)
    keys, sums = keys[order], sums[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    for key, total in zip(map(tuple, keys[starts].tolist()), np.add.reduceat(sums, starts, axis=0)):
        into[key] = into[key] + total if key in into else total


def _sent(into: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    y, cell = ([key[k] for key in into] for k in (0, 1))
    sums = [v.tolist() for v in into.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(y, pa.int32()), pa.array(cell, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["y", "cell", "sums"]
    )


def _cells(rows: DataFrame, model: Model, width: float, moments: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By label: cells of score in order, and the sums of their rows: counts, then features and their products in units."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(FEATURES))
            z = model.scaled(x)
            keys = np.stack([batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(model.weighed(z) / width).astype(np.int64)], axis=1)
            for at in range(0, len(z), 2048):
                some = z[at : at + 2048]
                sums = [np.ones((len(some), 1), np.int64)]
                if moments:
                    sums += [np.rint(some * UNIT).astype(np.int64), np.rint(some[:, _UPPER[0]] * some[:, _UPPER[1]] * UNIT).astype(np.int64)]
                _added(keys[at : at + 2048], np.hstack(sums), into)
        yield _sent(into)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if len(batch):
                keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], axis=1)
                _added(keys, batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), into)
        yield _sent(into)

    kind = "y int, cell long, sums array<long>"
    found = rows.select("x", "y").mapInArrow(part, kind).repartition("y", "cell").mapInArrow(whole, kind).collect()
    out = {}
    for y in (0, 1):
        own = sorted((r["cell"], r["sums"]) for r in found if r["y"] == y)
        wide = _WIDTH if moments else 1
        out[y] = np.array([c for c, _ in own], np.int64), np.array([s for _, s in own], np.int64).reshape(len(own), wide)
    return out


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of features and of their products, as floats."""
    d = len(FEATURES)
    square = np.zeros((len(sums), d, d))
    square[:, _UPPER[0], _UPPER[1]] = square[:, _UPPER[1], _UPPER[0]] = sums[:, 1 + d :] / UNIT
    return sums[:, 0].astype(float), sums[:, 1 : 1 + d] / UNIT, square


def _step(good: np.ndarray, bad: np.ndarray, weights: np.ndarray, ridge: float) -> np.ndarray:
    """The Newton step of the mean logistic loss over all pairs of a good and a bad row, from the sums of their cells."""
    (n, first, square), (m, other, rest) = _moments(good), _moments(bad)
    a, b = first / n[:, None], other / m[:, None]
    p = 1 / (1 + np.exp(np.clip((a @ weights)[:, None] - (b @ weights)[None, :], -30, 30)))
    share = (n[:, None] / n.sum()) * (m[None, :] / m.sum())
    wrong, v = share * p, share * p * (1 - p)
    gradient = wrong.sum(axis=0) @ b - wrong.sum(axis=1) @ a + ridge * weights
    cross = a.T @ v @ b
    h = np.tensordot(v.sum(axis=1) / n, square, 1) + np.tensordot(v.sum(axis=0) / m, rest, 1) - cross - cross.T + ridge * np.eye(len(weights))
    return np.linalg.solve(h, gradient)


def train(docs: DataFrame, labels: DataFrame, learnable: Callable, steps: int = 25, ridge: float = 1e-3) -> Model:
    """Fit on all pairs of all learnable labelled rows; without both labels every text scores 0.5.

    Ids whose labels disagree, null labels and null ids are left out; each row of a labelled id counts.  Features of texts, not texts, are shuffled.
    """
    d = len(FEATURES)
    model = Model(np.zeros(d), np.zeros(d), np.ones(d))
    known = agreed(labels, "quality", learnable)
    found = docs.where(F.col("doc_id").isNotNull() & learnable(F.col("doc_id"))).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = found.mapInArrow(_featured, "doc_id long, x array<double>")
    rows = materialise(salted_lookup(found, known, ["doc_id"]).select("x", "y"), "labelled")
    cells = _cells(rows, model, CELL)
    if not len(cells[0][0]) or not len(cells[1][0]):
        return model
    n, first, square = (v.sum(axis=0) for v in _moments(np.vstack([cells[0][1], cells[1][1]])))
    model.centre = first / n
    model.spread = np.maximum(np.sqrt(np.maximum(np.diag(square) / n - model.centre**2, 0)), 1e-3)
    for _ in range(steps):
        cells = _cells(rows, model, CELL)
        step = _step(cells[1][1], cells[0][1], model.weights, ridge)
        size = np.abs(step).max()
        model.weights = model.weights - step * min(1.0, 5 / max(size, 1e-12))
        # means of cells bring in errors of about this size
        if size < 1e-3:
            break
    n, first, square = (v.sum(axis=0) for v in _moments(np.vstack([cells[0][1], cells[1][1]])))
    mean = first / n
    model.scale = float(max(np.sqrt(max(model.weights @ (square / n - np.outer(mean, mean)) @ model.weights, 0.0)), 1e-3))
    fine = _cells(rows, model, FINE, moments=False)
    cuts = np.unique(np.concatenate([c for at, _ in fine.values() for c in (at, at + 1)]))
    under = {y: np.r_[0, np.cumsum(sums[:, 0])][np.searchsorted(at, cuts)] / sums[:, 0].sum() for y, (at, sums) in fine.items()}
    # balanced enough that rare labels count, yet most documents decide
    right = (1 - under[1]) * 0.7 + under[0] * 0.3
    model.threshold = float(np.median(cuts[right >= right.max() - 1e-12]) * FINE)
    return model


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        x = np.array([features(text.as_py() or b"") for text in batch.column(at).cast(pa.large_binary())], float).reshape(
            len(batch), len(FEATURES)
        )
        yield batch, model.scores(x)


def rate(docs: DataFrame, model: Model, held) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; no shuffle.

    Null and empty texts are scored as texts with no words.  Null ids, ties and repeated rows pass through row by row; very long texts
    are read whole; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _score(model, batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", held.alias("held_out"), docs["text"].cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted 1, with all columns; no shuffle and no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _score(model, batches):
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.pmod(id_crc(doc_id), F.lit(3)) == 1


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return rate(docs, model, held_out(F.col("doc_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
