"""Hierarchical language identification.

Texts become hashed byte trigrams of their letters.  A first stage of one linear model per family picks the family of languages; within
a family, a linear support vector machine for each pair of languages votes.  Every weight is trained here, on a
bounded sample of ``per_language`` rows of each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.common import id_crc, read
from vectrine.llm.learn import linear_svm

DIMENSIONS = 2048
PER_LANGUAGE = 1500
TRAIN_ROWS = 24_000
LANGUAGES = 200
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_GAPS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    """A language outside the table is a family of its own."""
    return _FAMILY.get(lang.split("-")[0].lower(), f"={lang}")


def features(text: str) -> np.ndarray:
    """Square roots of trigram counts, scaled to length 1."""
    a = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_GAPS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(21)
    counts = np.sqrt(np.bincount(h, minlength=DIMENSIONS)).astype(np.float32)
    return counts / np.linalg.norm(counts)


@dataclass
class Model:
    """families: names, with a row of weights each; pairs: of each family, (one, other, weights, intercept)."""

    families: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    intercepts: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        if len(self.families) > 1:
            margin = self.weights @ x + self.intercepts
            best = int(np.argmax(margin))
            sure = 1 / (1 + np.exp(-3 * (margin[best] - np.delete(margin, best).max())))
        else:
            best, sure = 0, 1.0
        family = self.families[best]
        langs = self.members[family]
        votes = np.zeros(len(langs))
        for one, other, w, b in self.pairs[family]:
            p = 1 / (1 + np.exp(-3 * (w @ x + b)))
            votes[one] += p
            votes[other] += 1 - p
        if len(langs) == 1:
            return langs[0], float(sure)
        winner = int(np.argmax(votes))
        return langs[winner], float(sure * votes[winner] / (len(langs) - 1))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(text.as_py() or "").astype(np.float16).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def train(
    docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS, languages: int = LANGUAGES
) -> Model:
    """Fit on about ``per_language`` distinct texts of each language at most, and about ``rows`` of all, drawn by a seeded hash of the text.

    Rows that share an id, or have none, are drawn like any others; copies of a text count once for each language.  Of more than
    ``languages`` values of lang, the most frequent are learned.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(7), "text").alias("drawn")
    )
    held = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("drawn", 0.02).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in held.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    each = min(per_language, rows // max(1, len(counts)))
    share = {lang: int((1 << 30) * min(1.0, each / max(1, n))) for lang, n in counts.items()}
    wanted = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(s)) for lang, s in share.items())) if share else F.lit(0)
    some = known.where(F.pmod("drawn", F.lit(1 << 30)) < wanted).dropDuplicates(["lang", "drawn"])
    rows = some.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), DIMENSIONS)
    langs = np.array([r["lang"] for r in rows], object)
    model = Model()
    for lang in sorted(set(langs)):
        model.members.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.members)
    own = np.array([family_of(lang) for lang in langs], object)
    fits = [linear_svm(x, np.where(own == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else []
    if fits:
        model.weights, model.intercepts = np.array([w for w, _ in fits], np.float32), np.array([b for _, b in fits], np.float32)
    for f, members in model.members.items():
        model.pairs[f] = []
        for i, j in combinations(range(len(members)), 2):
            chosen = np.isin(langs, [members[i], members[j]])
            w, b = linear_svm(x[chosen], np.where(langs[chosen] == members[i], 1.0, -1.0))
            model.pairs[f].append((i, j, w.astype(np.float32), b))
    return model


def identify(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; no shuffle.

    A null text, or one without any letter, is ``und`` with score 0, as is every text if nothing could be learned.  Null ids, ties
    and repeated rows pass through row by row; very long texts are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64())
                ],
                ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    return identify(docs, train(docs, ~held), held)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
