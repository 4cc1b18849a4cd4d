"""Fuzzy short-notice search over whole texts.

A text becomes its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower case, joined by single spaces.  A notice that
may hold ``k`` character edits is cut into ``k + 1`` seeds; by pigeonhole every occurrence within ``k`` edits holds one
seed unchanged, so an exact multi-pattern search for the seeds finds all candidate places.  Around each, the ``regex`` library's
bounded-error matching decides, and reports the span and its number of edits.  No place is sampled or capped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from vectrine.llm.common import read

#: Exact phrases of the base counts.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, their labels and the edits (in characters) that each may hold.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("creative commons attribution", "cc-by", 2),
    ("mozilla public license", "mpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("eclipse public license", "epl", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("bsd 3 clause license", "bsd", 1),
    ("all rights reserved", "all-rights-reserved", 1),
    ("spdx license identifier", "spdx", 2),
)
_GAP = re.compile(" ")
_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive parts of the phrase, each with its offset."""
    parts, n = edits + 1, len(phrase)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for at, (phrase, _, edits) in enumerate(NOTICES):
        for offset, seed in seeds(phrase, edits):
            found.setdefault(seed, []).append((at, offset))
    machine = ahocorasick.Automaton()
    for seed, places in found.items():
        machine.add_word(seed, (len(seed), tuple(places)))
    machine.make_automaton()
    return machine


@cache
def _patterns() -> tuple[regex.Pattern, ...]:
    """Of each notice, its best match at the start of a piece, up to the end of a word."""
    return tuple(
        regex.compile(f"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={edits}}}(?![^ ])") for phrase, _, edits in NOTICES
    )


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACE).split()


def match_at(joined: str, notice: int, start: int, known: dict | None = None) -> tuple[int, int, str, int] | None:
    """(start, end, label, edits) if the notice stands at ``start``, the first character of a word, within its edits."""
    phrase, label, edits = NOTICES[notice]
    # one character more than any match, so that it tells whether a word ends there
    piece = joined[start : start + len(phrase) + edits + 1]
    known = {} if known is None else known
    if (notice, piece) not in known:
        m = _patterns()[notice].match(piece)
        known[notice, piece] = (m.end(), sum(m.fuzzy_counts)) if m else None
    fit = known[notice, piece]
    return (start, start + fit[0], label, fit[1]) if fit else None


def fuzzy_spans(joined: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) in characters of the joined words; of overlapping places, the one with fewest edits, then the longest, then the first."""
    # where a notice would start if nothing before the seed were changed; several seeds often say the same
    guesses: set[tuple[int, int]] = set()
    for end, (length, seeded) in _automaton().iter(joined):
        at = end + 1 - length
        guesses.update([(notice, at - offset) for notice, offset in seeded])
    places: set[tuple[int, int]] = set()
    for notice, start in guesses:
        # the edits before the seed move the start by as much at most; it starts a word
        edits = NOTICES[notice][2]
        if start <= edits:
            places.add((notice, 0))
            start = max(start, edits + 1)
        high = start + edits
        at = joined.find(" ", start - edits - 1, high)
        while at >= 0:
            places.add((notice, at + 1))
            at = joined.find(" ", at + 1, high)
    known: dict = {}
    found = [m for notice, start in places if (m := match_at(joined, notice, start, known))]
    found.sort(key=lambda x: (x[3], x[0] - x[1], x[0], x[2]))
    # kept places don't overlap, so only the neighbours of a new one can
    kept: list[tuple[int, int, str, int]] = []
    for x in found:
        k = bisect_left(kept, x)
        if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
            kept.insert(k, x)
    return kept


def gaps(joined: str) -> list[int]:
    """Where the spaces stand; a character's word is the number of spaces before it."""
    return [m.start() for m in _GAP.finditer(joined)]


def base_places(joined: str, spaces: list[int] | None = None) -> list[tuple[int, str]]:
    """(first word, label) of each place where a base phrase's words stand consecutively."""
    spaces = gaps(joined) if spaces is None else spaces
    padded = f" {joined} "
    found = []
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((bisect_left(spaces, at), label))
            at = padded.find(f" {phrase} ", at + 1)
    return found


def scan(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans; in time about linear in the text."""
    words = words_of(text)
    joined = b" ".join(words).decode("utf-8", "replace")
    spans = fuzzy_spans(joined)
    has_base = "license" in joined
    spaces = gaps(joined) if spans or has_base else []
    base = base_places(joined, spaces) if has_base else []
    base_labels = {label for _, label in base}
    labels = base_labels | {label for _, _, label, _ in spans}
    score = 1.0 if base else max((1 - edits / (end - start) for start, end, _, edits in spans), default=0.0)
    places = [at for at, _ in base]
    word_spans = [(bisect_left(spaces, start), bisect_left(spaces, end), label, edits) for start, end, label, edits in spans]
    return len(words), len(base), min(
        places, default=None
    ), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, word_spans


SPANS = "spans array<struct<first_word:long,last_word:long,label:string,edits:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, {
    SPANS
}"
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch in batches:
        found = [scan(text.as_py()) for text in batch.column(1)]
        columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types)]
        spans = pa.array([[dict(zip(("first_word", "last_word", "label", "edits"), s)) for s in x[7]] for x in found], _SPANS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, spans], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts, labels, score and the spans (in words) of all fuzzy matches; no shuffle.

    Null and empty texts have no words, no places and score 0.  Null doc_ids, ties and repeated rows pass through row by row;
    very long texts are scanned whole; an empty table gives none; other columns of ``docs`` are ignored.
    """
    return docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInArrow(_scan, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
