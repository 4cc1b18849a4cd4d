"""Best-fit packing by minimum bin slack.

For the next bin, the longest piece that is left is taken, and a bitset subset-sum dynamic programme over the available lengths finds the fullest
combination with it.  Only lengths matter, so the programme runs on counts of lengths (at most ``capacity`` of them, however
many documents there are), and a combination is used for as many bins as the counts allow before the next is sought.  Pieces
then find their places by length and by rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.llm.common import materialise, read

CAPACITY = 2048
END = 0
#: A run of white space that long is more than the stack of ``tiktoken`` may hold.
_SPACES = re.compile(r"(?<!\s)\s{20000}")


def default_tokenizer() -> tuple[str, str]:
    """The vocabulary as a file of ``tokenizers`` and, the same one, as ranks for ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _tokenizers(json_path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return slow, None, ()
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, tuple(token.content for token in slow.get_added_tokens_decoder().values())


def encode(text: str, json_path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids that ``tokenizers`` gives with ``add_special_tokens=False``.

    With ranks of the same vocabulary, ``tiktoken`` computes them, in a fifth of the time; a text that names a special token, or
    holds a very long run of white space, still goes through ``tokenizers``.
    """
    slow, fast, special = _tokenizers(json_path, ranks_path)
    if fast is None or any(token in text for token in special) or _SPACES.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids; the first may be shorter."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def _pieces(paths: tuple[str, str | None], capacity: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or "", *paths), np.uint32(END)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                part = ids[start : start + length]
                rows.append(
                    (
                        doc_id,
                        k,
                        start,
                        length,
                        zlib.crc32(part.tobytes()),
                        task,
                        int(seen[length]),
                        part.astype(np.int32) if with_ids else None
                    )
                )
                seen[length] += 1
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
        )


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> list[tuple[int, int]]:
    """(length, how many) of the fullest combination of available pieces in ``room``; longer pieces are preferred."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        held = min(counts[length], room // length) if length <= room else 0
        if not held:
            continue
        steps.append((length, held, reach))
        step, left = 1, held
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, held, before in reversed(steps):
        n = next(n for n in range(held + 1) if n * length <= at and before >> (at - n * length) & 1)
        if n:
            chosen.append((length, n))
            at -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((length, first rank, first bin, pieces a bin, offset) ..., number of bins) for counts of lengths.

    The rows of a length are in order of ranks.
    """
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    rows, bins = [], 0
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        chosen = dict(fullest(left, capacity - longest, lengths))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], bins, n, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        bins += times
        lengths = [length for length in lengths if left[length]]
    return rows, bins


def _place(table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = table[:, 0] << 48 | table[:, 1]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1] if len(batch) else table[:0]
        k = rank - row[:, 1]
        sequence, offset = row[:, 2] + k // np.maximum(row[:, 3], 1), row[:, 4] + k % np.maximum(row[:, 3], 1) * length
        kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
            [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"]
        )


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    paths: the tokenizer's file and, or None, ranks of the same vocabulary.  A null or empty text is the one id 0.  Repeated rows
    and null ids are packed like any others; very long texts are cut, not shortened; an empty table gives none; other columns are ignored.
    """
    paths = paths or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids array<int>"
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_pieces, paths, capacity, with_ids), schema)
    pieces = materialise(pieces if with_ids else pieces.drop("ids"), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = materialise(
        by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "lengths"
    )
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
    ranked = pieces.join(by_task.select("task", "length", "before").hint("merge"), ["task", "length"]).withColumn(
        "rank", F.col("before") + F.col("nth")
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.select(columns).mapInArrow(partial(_place, table), out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
