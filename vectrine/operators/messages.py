"""Grouping of messages by time gaps and by length, with overlap, as one streamed fold over sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.storage import written

GROUPED = "conv long, group_no long, pos long, t long, text string, carried boolean"


def group_messages(messages: DataFrame, max_length: int = 128, window_minutes: int = 30, overlap: int = 0) -> DataFrame:
    """Rows of ``messages`` (conv, pos, t in epoch seconds, text) with their group_no, from 0 within a conversation.

    A group ends before a message that comes more than ``window_minutes`` after the last one, or that would make it longer than ``max_length``
    characters; -1 switches a rule off.  The last ``overlap`` messages of a longer group also open the next one (carried).  Blank
    texts are left out.  A conversation is read in order of pos, one message at a time, and never held whole.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, group, length, last = None, 0, [], 0, None
        for batch in batches:
            out: list[tuple] = []
            for c, pos, t, text in zip(*(column.to_pylist() for column in batch.columns)):
                if c != conv:
                    conv, number, group, length, last = c, 0, [], 0, None
                if not (text or "").strip():
                    continue
                t = t or 0
                gap = window_minutes != -1 and last is not None and t > 0 and (t - last) / 60 > window_minutes
                for closes in (gap, None):
                    if closes is None:
                        closes = max_length != -1 and bool(group) and length + len(text) > max_length
                    if closes and group:
                        group = group[-overlap:] if 0 < overlap < len(group) else []
                        length = sum(len(m[2]) for m in group)
                        number += 1
                        out += [(conv, number, *m, True) for m in group]
                group.append((pos, t, text))
                # only what can still be carried is kept
                group = group[-(overlap + 1) :]
                length += len(text)
                last = t
                out.append((conv, number, pos, t, text, False))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["conv", "group_no", "pos", "t", "text", "carried"]
            )

    ordered = messages.select("conv", "pos", "t", "text").repartition("conv").sortWithinPartitions("conv", "pos")
    return ordered.mapInArrow(fold, GROUPED)


def summarise(grouped: DataFrame) -> DataFrame:
    """messages, total_length, start_time and end_time of each group."""
    ends = F.struct("pos", "t")
    out = grouped.groupBy("conv", "group_no").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("total_length"), F.min(ends).alias("a"), F.max(ends).alias("b")
    )
    return out.select("conv", "group_no", "messages", "total_length", F.col("a.t").alias("start_time"), F.col("b.t").alias("end_time"))


def time_sessions(events: DataFrame, key: str, time: str, gap_minutes: int = 30, tasks: int | None = None) -> DataFrame:
    """``events`` with session_no: a new session after a gap of more than ``gap_minutes``; a null key is a key of its own.

    Events are split into ranges of key and time and written, so that a key of any size is spread over tasks; each range of a key
    adds one row, from which follows how many sessions were opened before it.
    """
    gap = gap_minutes * 60_000_000
    moment = F.unix_micros(F.col(time).cast("timestamp")).alias("_at")
    ranged = events.select(F.struct("*").alias("row"), F.col(key).alias("_key"), moment).repartitionByRange(*([] if tasks is None else [tasks]), "_key", "_at")
    placed = written(ranged.withColumn("_r", F.spark_partition_id()), "sessions")
    order = Window.partitionBy("_r", "_key").orderBy("_at")
    opened = F.coalesce(F.col("_at") - F.lag("_at").over(order) > gap, F.lit(False)).cast("long")
    local = placed.withColumn("_new", opened)
    parts = local.groupBy("_r", "_key").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.sum("_new").alias("n"))
    # at most one row of each range for each key
    of_key = Window.partitionBy("_key").orderBy("_r")
    parts = parts.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(of_key) > gap, F.lit(False)).cast("long"))
    upto = F.sum(F.col("n") + F.col("opens")).over(of_key.rowsBetween(Window.unboundedPreceding, 0))
    before = parts.select(F.col("_r").alias("r"), F.col("_key").alias("k"), (upto - F.col("n")).alias("before"))
    joined = local.join(before, (F.col("_r") == F.col("r")) & F.col("_key").eqNullSafe(F.col("k")))
    number = F.col("before") + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("row.*", number.alias("session_no"))


def readable(content: Column) -> Column:
    """Message text without its sender prefixes; empty for markup and recalls."""
    bare = F.regexp_replace(F.regexp_replace(content, r"^wxid_[^:]+:\s*", ""), r"^[^:]+:\s*", "")
    text = F.trim(bare)
    return F.when(content.isNull() | F.startswith(text, F.lit("<")) | F.contains(bare, F.lit("recalled a message")), "").otherwise(text)


def readable_fields(content: Column) -> Column:
    """Text of a VARIANT content: an object's title, quoted, content and text in that order, else the string itself."""
    parts = [F.try_variant_get(content, f"$.{name}", "string") for name in ("title", "quoted", "content", "text")]
    is_object = F.startswith(F.schema_of_variant(content), F.lit("OBJECT"))
    return F.when(is_object, F.concat_ws(" | ", *parts)).otherwise(readable(F.try_variant_get(content, "$", "string")))


def is_text_message(content: Column) -> Column:
    """Whether a message's content is text that a person reads, rather than media, a file card, or a notice."""
    has = lambda *parts: [F.contains(content, F.lit(p)) for p in parts]
    image, image_url = has("<img", "cdnurl")
    emoji, product = has("<emoji", "productid")
    card, app = has("<appmsg", "appid")
    voice, video, recalled = has("<voice", "<video", "recalled a message")
    media = (image & image_url) | (emoji & product) | (card & app) | voice | video | recalled
    return F.coalesce(~media & (readable(content) != ""), F.lit(False))


def clock(seconds: Column) -> Column:
    """Epoch seconds in the session's time zone; ``Unknown`` for 0 or null."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "Unknown").otherwise(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
    )


def message_line(seconds: Column, own: Column, text: Column) -> Column:
    return F.concat(F.lit("("), clock(seconds), F.lit(") "), F.when(own, "[Me]").otherwise("[Contact]"), F.lit(": "), text)
