"""Command line: build, search, ask, list, remove."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from vectrine import index
from vectrine.operators import chunk
from vectrine.sources import files


def session() -> SparkSession:
    spark = SparkSession.builder.appName("vectrine").config("spark.sql.session.timeZone", "UTC").config(
        "spark.ui.showConsoleProgress", "false"
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("vectrine")
    out.add_argument("--folder", default=".vectrine/indexes", help="where indexes are kept")
    steps = out.add_subparsers(dest="step", required=True)
    build = steps.add_parser("build")
    build.add_argument("name")
    build.add_argument("--docs", nargs="+", default=["."])
    build.add_argument("--file-types")
    build.add_argument("--include-hidden", action="store_true")
    build.add_argument("--backend", default="graph", choices=index.discover())
    build.add_argument("--embedding-mode", default="hash")
    build.add_argument("--embedding-model", default="64")
    build.add_argument("--chunk-size", type=int, default=256)
    build.add_argument("--chunk-overlap", type=int, default=128)
    build.add_argument("--no-recompute", action="store_true")
    build.add_argument("--force", action="store_true")
    for name in ("search", "ask"):
        step = steps.add_parser(name)
        step.add_argument("name")
        step.add_argument("text", nargs="?" if name == "ask" else None)
        step.add_argument("--top-k", type=int, default=5)
        step.add_argument("--complexity", type=int, default=64)
        if name == "ask":
            step.add_argument("--llm", default="simulated")
            step.add_argument("--model", default="")
            step.add_argument("--thinking-budget", choices=("low", "medium", "high"))
    steps.add_parser("list")
    remove = steps.add_parser("remove")
    remove.add_argument("name")
    remove.add_argument("--force", action="store_true")
    remove.add_argument("--confirm")
    return out


def locate(folder: str, name: str) -> str:
    """An index of this folder, else the only one of that name in any project."""
    own = Path(folder, name)
    if (own / "manifest.json").is_file():
        return str(own)
    hits = index.find(name)
    if len(hits) != 1:
        raise SystemExit(f"{len(hits)} indexes are named {name}" + "".join(f"\n  {i['path']}" for i in hits))
    return hits[0]["path"]


def line(row) -> str:
    return f"{row['rank']}. {row['score']:.3f} {row['text'][:200]}"


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.step == "list":
        for i in index.indexes([*dict.fromkeys([a.folder, *index.projects()])]):
            print(f"{i['name']}\t{i['passages']} passages\t{i['mb']:.1f} MB\t{i['path']}")
        return 0
    if a.step == "remove":
        print(index.remove(a.name, [*dict.fromkeys([a.folder, *index.projects()])], a.force, a.confirm))
        return 0
    spark = session()
    if a.step == "build":
        docs = files.read(spark, a.docs, files.parse_extensions(a.file_types), a.include_hidden)
        size, overlap = chunk.checked(a.chunk_size, a.chunk_overlap)
        chunks = chunk.chunk_documents(docs, text_profile=(size, overlap)).withColumnRenamed("chunk", "text").drop("size")
        m = index.Builder(
            spark, a.backend, a.embedding_model, a.embedding_mode, is_recompute=not a.no_recompute, is_compact=not a.no_recompute
        ).add_documents(chunks).build(str(Path(a.folder, a.name)), a.force)
        print(f"{a.name}: {m.rows} passages")
        return 0
    path = locate(a.folder, a.name)
    if a.step == "search":
        for row in index.Searcher(spark, path).search(a.text, a.top_k, a.complexity).collect():
            print(line(row))
        return 0
    chat = index.Chat(spark, path, {"type": a.llm, "model": a.model})
    options = {
        "top_k": a.top_k, "llm_options": {"thinking_budget": a.thinking_budget} if a.thinking_budget else None, "complexity": a.complexity
    }
    if a.text is None:
        # a question a line, until quit
        chat.loop(sys.stdin, **options)
    else:
        print(chat.ask(a.text, **options))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
