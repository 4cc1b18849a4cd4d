"""Line-first cleaning: rules drop single lines, then documents that lose too much text are rejected.

A line (split at ``\\n``) with a word fails as

* punctuation: more than a tenth of its words hold a symbol of ``#*$%&|<>`` or end in a run of marks such as ``!!``,
  or it has fewer than five words, no end mark and is not the document's only line (a stub);
* navigation: it holds two or more separators `` | ``, `` > ``, `` » `` or `` · `` and at least a fifth as many as words;
* boilerplate: it has at most 40 words and holds one of the phrases of ``BOILERPLATE``.

A document is rejected when its failed lines hold more than ``max_lost`` of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vectrine.llm.common import read

BOILERPLATE = (
    "javascript is disabled",
    "enable cookies",
    "we use cookies",
    "cookie policy",
    "terms of use",
    "privacy policy",
    "all rights reserved",
    "sign up for our newsletter",
    "click here to",
    "lorem ipsum"
)
MAX_LOST_PERCENT = 50
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_RUN = re.compile(rb"[!?*]{2}[.,]?$")
_MARKED = re.compile(rb"[#*$%&|<>]|[!?*]{2}")
_SEPARATORS = frozenset((b"|", b">", "»".encode(), "·".encode()))
_ENDS = tuple(x.encode() for x in (".", "!", "?", '"', "'", ":", ";", ")", "]", "”", "»", "…", "。", "！", "？"))
_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_MULTIBYTE = bytes(range(0x80, 0xC0))


def line_fails(line: bytes, only: bool = False) -> str | None:
    """The rule that a line with a word fails, or None."""
    words = line.split()
    n = len(words)
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= 2 and 5 * separators >= n:
        return "navigation"
    marked = sum(1 for w in words if _SYMBOL.search(w) or _RUN.search(w)) if _MARKED.search(line) else 0
    if 10 * marked > n:
        return "punctuation"
    if n < 5 and not only and not words[-1].endswith(_ENDS):
        return "punctuation"
    if n <= 40 and _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words lie in windows that are found twice or more, the first included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    end = total = 0
    for at, gram in enumerate(grams):
        if count[gram] > 1:
            total += at + window - max(at, end)
            end = at + window
    return total


def measure(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost words, failed lines."""
    words = text.split()
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.split()]
    lost = failed = 0
    for line in lines:
        if line_fails(line, len(lines) == 1):
            failed += 1
            lost += len(line.split())
    return len(words), len(
        joined.translate(None, _MULTIBYTE)
    ), len(_SYMBOL.findall(joined)), len(lines) - len(set(lines)), repeated_words(words), lost, failed


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, n_failed_lines long, base_failed boolean, kept boolean"


def _judge(max_lost: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text.as_py() or b"") for text in batch.column(1)]
            columns = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 7
            base = [n < 10 or 100 * r > 20 * n for n, _, _, _, r, _, _ in found]
            kept = [not b and 100 * m[5] <= max_lost * m[0] for b, m in zip(base, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), *batch.columns[2:]],
                [
                    "doc_id",
                    "n_words",
                    "word_chars",
                    "n_symbols",
                    "n_dup_lines",
                    "n_repeat_words",
                    "n_lost_words",
                    "n_failed_lines",
                    "base_failed",
                    "kept",
                    *batch.schema.names[2:]
                ]
            )

    return run


def judge(docs: DataFrame, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """Counts and verdict for each row of ``docs``; no shuffle.

    Null and empty texts have no words: base_failed, not kept.  Null doc_ids and repeated rows pass through row by row, very
    long texts are measured whole, an empty table gives none, and other columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(_judge(max_lost), SCHEMA)


def cleaned(text: bytes) -> bytes:
    """``text`` without its failed lines; lines without a word stay."""
    lines = text.split(b"\n")
    alone = sum(1 for line in lines if line.split()) == 1
    return b"\n".join(line for line in lines if not line.split() or not line_fails(line, alone))


def _clean(max_lost: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with cleaned texts; with ``max_lost``, only those that ``judge`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            good, texts = [], []
            for text in batch.column(at).cast(pa.large_binary()):
                raw = text.as_py()
                m = measure(raw or b"")
                kept = max_lost is None or (m[0] >= 10 and 100 * m[4] <= 20 * m[0] and 100 * m[5] <= max_lost * m[0])
                good.append(kept)
                if kept:
                    texts.append(raw if raw is None or not m[6] else cleaned(raw))
            out = batch.filter(pa.array(good, pa.bool_()))
            columns = list(out.columns)
            columns[at] = pa.array(texts, pa.large_binary()).cast(batch.schema.field(at).type)
            if size_at >= 0 and pa.types.is_integer(batch.schema.field(size_at).type):
                columns[size_at] = pc.utf8_length(columns[at]).cast(batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def keep_clean(docs: DataFrame, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns and without their failed lines; no shuffle and no join.

    An integer column n_chars is set to the new length.  Null and empty texts go; null ids and other columns, ties and repeated rows
    pass through row by row, very long texts are read whole, an empty table gives none.
    """
    return docs.mapInArrow(_clean(max_lost), docs.schema)


def clean_lines(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` without their failed lines; as ``keep_clean``, but that none is rejected and a null text stays null."""
    return docs.mapInArrow(_clean(None), docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_quality_rules": op3_quality_rules}

_PHRASES = "|".join(BOILERPLATE)
_ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT row_number() OVER () AS r, * FROM d
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM g
), l AS (
  SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines
), k AS (
  SELECT r, line, len(w) AS n, w[len(w)] AS last, count(*) OVER (PARTITION BY r) AS n_lines,
    len([x for x in w if x IN ('|', '>', '»', '·')]) AS seps,
    len([x for x in w if regexp_matches(x, '[#*$%&|<>]') OR regexp_matches(x, '[!?*]{2}[.,]?$')]) AS marked
  FROM l WHERE len(w) > 0
), f AS (
  SELECT r, line, n, (seps >= 2 AND 5 * seps >= n) OR 10 * marked > n
    OR (n < 5 AND n_lines > 1 AND NOT regexp_matches(last, '[.!?"'':;)\]”»…。！？]$'))
    OR (n <= 40 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '""" + _PHRASES + r"""')) AS bad
  FROM k
), fl AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, count_if(bad) AS failed FROM f GROUP BY r
), five AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM g WHERE len(w) >= 5)
), again AS (
  SELECT r, i FROM five QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM again, range(0, 5) AS t(o) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words, coalesce(failed, 0)::BIGINT AS n_failed_lines
  FROM g LEFT JOIN fl USING (r) LEFT JOIN covered USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept
FROM m
"""
ORACLES: dict[str, str] = {"op3_quality_rules": _ORACLE}
