"""A template of applications: read something, chunk it, index it, search or ask.

A subclass says what it reads (``arguments``, ``load``); ``READERS`` holds the readers that come along, by name, and takes others.
"""

from __future__ import annotations

import argparse
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine import index
from vectrine.operators import chunk
from vectrine.sources import chat, files, history, mail

#: name -> f(spark, path) -> DataFrame with a column ``text``
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str) -> Callable:
    """Registers a reader; the last one of a name counts."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        READERS[name] = function
        return function

    return add


@reader("files")
def _files(spark: SparkSession, path: str) -> DataFrame:
    return files.read(spark, [path])


@reader("code")
def _code(spark: SparkSession, path: str) -> DataFrame:
    return files.read_code(spark, path)


@reader("mail")
def _mail(spark: SparkSession, path: str) -> DataFrame:
    return mail.documents(mail.read(spark, path))


@reader("mailbox")
def _mailbox(spark: SparkSession, path: str) -> DataFrame:
    return mail.mailbox_documents(mail.read(spark, path, "mbox"))


@reader("history")
def _history(spark: SparkSession, path: str) -> DataFrame:
    return history.read(spark, path)


@reader("chat")
def _chat(spark: SparkSession, path: str) -> DataFrame:
    return chat.documents(chat.read(spark, path))


class App(ABC):
    """One application; ``profile`` names the sizes of its chunks."""

    name = "app"
    profile = "text"

    def arguments(self, parser: argparse.ArgumentParser) -> None:
        """Adds what only this application takes."""

    @abstractmethod
    def load(self, spark: SparkSession, options: argparse.Namespace) -> DataFrame:
        """Documents with a column ``text``; the other columns become metadata."""

    def parser(self) -> argparse.ArgumentParser:
        out = argparse.ArgumentParser(self.name)
        out.add_argument("--index", required=True, help="the index's folder")
        out.add_argument("--backend", default="graph")
        out.add_argument("--max-items", type=int, default=-1)
        out.add_argument("--force", action="store_true")
        out.add_argument("--query")
        out.add_argument("--top-k", type=int, default=5)
        out.add_argument("--llm")
        self.arguments(out)
        return out

    def chunks(self, docs: DataFrame) -> DataFrame:
        size, overlap = chunk.PROFILES[self.profile]
        path = "file_path" if "file_path" in docs.columns else None
        held = docs if path else docs.withColumn("file_path", F.lit("a.txt"))
        return chunk.chunk_documents(held, text_profile=(size, overlap)).withColumnRenamed("chunk", "text")

    def build(self, spark: SparkSession, options: argparse.Namespace) -> None:
        docs = self.load(spark, options)
        if options.max_items >= 0:
            docs = docs.orderBy(*docs.columns).limit(options.max_items)
        builder = index.Builder(spark, options.backend)
        builder.add_documents(self.chunks(docs)).build(options.index, options.force)

    def run(self, spark: SparkSession, arguments: list[str] | None = None) -> list[str]:
        """Build the index unless it is there, then answer the query: passages, or with a model its answer."""
        options = self.parser().parse_args(arguments)
        if options.force or not index.exists(spark, options.index):
            self.build(spark, options)
        if not options.query:
            return []
        if options.llm:
            return [index.Chat(spark, options.index, {"type": options.llm}).ask(options.query, options.top_k)]
        return [r["text"] for r in index.Searcher(spark, options.index).search(options.query, options.top_k).collect()]


class ReaderApp(App):
    """An application around one of ``READERS``."""

    def __init__(self, name: str):
        self.name = name
        self.profile = {"mail": "email", "mailbox": "email", "history": "browser", "chat": "chat"}.get(name, "text")

    def arguments(self, parser: argparse.ArgumentParser) -> None:
        parser.add_argument("--path", required=True)

    def load(self, spark: SparkSession, options: argparse.Namespace) -> DataFrame:
        return READERS[self.name](spark, options.path)
