"""Structured Streaming: documents that arrive are chunked, embedded and appended; messages are grouped as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectrine.operators import chunk, embed


def append_passages(
    stream: DataFrame, path: str, checkpoint: str, size: int = 256, overlap: int = 128, model: str = "64", mode: str = "hash"
) -> StreamingQuery:
    """Each batch of (doc_id, text) becomes word windows with vectors, written under the batch's number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk.word_windows(batch.select("doc_id", "text"), size, overlap)
        embed.embed(chunks, "chunk", model, mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions with their counts; events later than ``late`` are dropped."""
    window = F.session_window(time, gap)
    held = stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("messages"))
    return held.select(key, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "messages")


def length_groups(stream: DataFrame, max_length: int = 1000) -> DataFrame:
    """(conv, pos, group_no) of messages (conv, pos, text), grouped by length with state for each conversation."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, length = state.get if state.exists else (0, 0)
        rows = []
        for pos, text in sorted((p, t) for part in parts for p, t in zip(part["pos"], part["text"]) if (t or "").strip()):
            if length and length + len(text) > max_length:
                number, length = number + 1, 0
            length += len(text)
            rows.append((key[0], pos, number))
        state.update((number, length))
        yield pd.DataFrame(rows, columns=["conv", "pos", "group_no"])

    return stream.groupBy("conv").applyInPandasWithState(
        step, "conv long, pos long, group_no long", "number long, length long", "append", GroupStateTimeout.NoTimeout
    )
