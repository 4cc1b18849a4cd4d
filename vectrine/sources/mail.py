"""Mail: single-message files with a byte count in front, and mailboxes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions.text import html_text, mail_document, mail_parts, mailbox_document

SCHEMA = "file string, sender string, recipient string, subject string, date string, body string"
_START = re.compile(rb"^From [^\n]*\n", re.M)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in found], pa.string()) for i in range(6)], ["file", "sender", "recipient", "subject", "date", "body"]
    )


def _message(name: str, raw: bytes, include_html: bool) -> tuple:
    m = mail_parts(raw, include_html)
    body = html_text(m["body"]) if "<html" in m["body"].lower() else m["body"]
    return name, str(m["from"]), str(m["to"]), str(m["subject"]), str(m["date"]), body


def split_mailbox(raw: bytes) -> list[bytes]:
    """Messages of an mbox, by their ``From `` lines."""
    starts = [m for m in _START.finditer(raw) if m.start() == 0 or raw[m.start() - 2 : m.start()] == b"\n\n"]
    return [raw[m.end() : n.start() if n else len(raw)] for m, n in zip(starts, [*starts[1:], None])]


def parsed(files: DataFrame, kind: str = "emlx", include_html: bool = False) -> DataFrame:
    """Messages of raw files (file, content); kept are those with a body or a subject.  kind: ``emlx`` or ``mbox``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = split_mailbox(raw) if kind == "mbox" else [raw.split(b"\n", 1)[-1]]
                found += [_message(name, part, include_html) for part in parts]
            yield _rows(found)

    rows = files.select("file", "content").mapInArrow(run, SCHEMA)
    return rows.where((F.regexp_replace("body", "(?U)\\s+", "") != "") | (F.col("subject") != "No Subject"))


def read(spark: SparkSession, path: str, kind: str = "emlx", include_html: bool = False, max_count: int | None = None) -> DataFrame:
    """Messages below ``path``, in order of file, date and subject where ``max_count`` cuts them.

    A mailbox file is read whole by one task, so it has to be under 2 GB; split larger ones first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.emlx" if kind == "emlx" else "*"
    ).load(path)
    rows = parsed(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"), kind, include_html)
    return rows.orderBy("file", "date", "subject", "body").limit(max_count) if max_count is not None and max_count >= 0 else rows


def documents(messages: DataFrame) -> DataFrame:
    return messages.select(
        mail_document(F.col("file"), F.col("sender"), F.col("recipient"), F.col("subject"), F.col("date"), F.col("body")).alias("text"),
        "file",
        "subject"
    )


def mailbox_documents(messages: DataFrame) -> DataFrame:
    """Messages of a mailbox, whose file says nothing about one of them."""
    return messages.select(
        mailbox_document(F.col("sender"), F.col("recipient"), F.col("subject"), F.col("date"), F.col("body")).alias("text"), "subject"
    )
