"""Indexes on disk: build, search, ask, list and remove.

An index is a folder, local or on a store that Spark knows: Parquet datasets ``passages`` and the backend's own (``graph``, or ``codes`` and ``books``),
``embeddings`` unless the index is pruned, and ``manifest.json``, which is written last.
"""

from __future__ import annotations

import importlib
import json
import os
import pkgutil
import shutil
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions.filters import apply_filters
from vectrine.functions.vector import default_metric, dimension, is_finite, metric
from vectrine.operators import embed, graph, knn, passages, pq, rag
from vectrine.schema import Manifest, Store

BACKENDS: dict[str, type[Backend]] = {}
OPTIONS = {"metric", "is_compact", "is_recompute"}
#: Packages whose names begin so are imported when an unknown backend is asked for; they register their own.
PLUGIN_PREFIX = "vectrine_backend_"


class Backend(ABC):
    """What an index is searched by.  options: the names of build options that it takes."""

    options: set[str] = set()

    @abstractmethod
    def build(self, vectors: DataFrame, manifest: Manifest, path: str, passages: DataFrame) -> None:
        """Write what the search needs beside the passages."""

    @abstractmethod
    def search(self, index: Searcher, queries: DataFrame, k: int, recompute: bool, **options: Any) -> DataFrame:
        """(qid, id, score, rank) of the ``k`` best."""


def register_backend(name: str):
    """Class decorator for a subclass of ``Backend``."""

    def add(cls: type[Backend]) -> type[Backend]:
        BACKENDS[name] = cls
        return cls

    return add


def discover() -> list[str]:
    """Import plug-in packages, in order of their names; the names of all backends, in order."""
    for name in sorted(m.name for m in pkgutil.iter_modules() if m.name.startswith(PLUGIN_PREFIX)):
        importlib.import_module(name)
    return sorted(BACKENDS)


def found_backend(name: str) -> type[Backend]:
    if name not in BACKENDS and name not in discover():
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


@register_backend("graph")
class GraphBackend(Backend):
    """A sharded proximity graph.  With ``codes`` the layout holds product codes, by which a search can prune."""

    options = {"degree", "candidates", "alpha", "codes"}

    def build(self, vectors: DataFrame, manifest: Manifest, path: str, passages: DataFrame) -> None:
        o = manifest.backend_kwargs
        built = graph.build(vectors, manifest.metric, o.get("degree", 32), o.get("candidates", 200), o.get("alpha", 1.2), manifest.rows)
        built.write.mode("overwrite").parquet(f"{path}/adjacency")
        built = vectors.sparkSession.read.parquet(f"{path}/adjacency")
        codes = None
        if o.get("codes"):
            books = pq.train(vectors, pq.code_parts(manifest.dimensions, None, manifest.rows))
            pq.write_books(books, vectors.sparkSession, f"{path}/books")
            codes = pq.encode(vectors, books)
        data = passages.select(F.col("pos").alias("id"), "text") if manifest.is_recompute else vectors
        graph.layout(built, data, codes).write.mode("overwrite").parquet(f"{path}/graph")
        Store(vectors.sparkSession).delete(f"{path}/adjacency")

    def search(self, index: Searcher, queries: DataFrame, k: int, recompute: bool, **options: Any) -> DataFrame:
        m = index.manifest
        held = index.spark.read.parquet(f"{index.folder}/graph")
        data = None
        if recompute != m.is_recompute:
            data = index.passages.select(F.col("pos").alias("id"), "text") if recompute else index.embeddings()
            held = held.drop("text", "embedding")
        books = pq.read_books(
            index.spark, f"{index.folder}/books"
        ) if options.get("prune_ratio", 0) > 0 and m.backend_kwargs.get("codes") else None
        # scores of models that return unit vectors lie close together, so that the beam would stop too soon
        stop_early = not (m.metric == "cosine" and m.embedding_mode == "openai")
        return graph.search(
            held,
            data,
            queries,
            k,
            m.metric,
            recompute=(m.embedding_mode, m.embedding_model) if recompute else None,
            is_pruned=m.is_pruned,
            rows=m.rows,
            stop_early=stop_early,
            books=books,
            **options
        )


@register_backend("disk")
class DiskBackend(Backend):
    """Product codes and codebooks on disk: all codes are scored, and the shortlist's vectors are read, or recomputed once, for exact scores."""

    options = {"parts", "codes_per_part", "search_memory_gb"}

    def build(self, vectors: DataFrame, manifest: Manifest, path: str, passages: DataFrame) -> None:
        o = manifest.backend_kwargs
        parts = o.get("parts") or pq.code_parts(manifest.dimensions, o.get("search_memory_gb"), manifest.rows)
        books = pq.train(vectors, parts, o.get("codes_per_part", 256))
        # staged, counted, then put in place, so that a failed build leaves the old index whole
        staged = f"{path}/_staged_codes"
        pq.encode(vectors, books).write.mode("overwrite").parquet(staged)
        if vectors.sparkSession.read.parquet(staged).count() != manifest.rows:
            raise RuntimeError("codes are missing")
        store = Store(vectors.sparkSession)
        pq.write_books(books, vectors.sparkSession, f"{path}/books")
        store.delete(f"{path}/codes")
        store.rename(staged, f"{path}/codes")

    def search(
        self, index: Searcher, queries: DataFrame, k: int, recompute: bool, complexity: int = 64, strategy: str = "global", **options: Any
    ) -> DataFrame:
        m = index.manifest
        if strategy == "proportional":
            raise NotImplementedError("the disk backend has no proportional pruning")
        if options.pop("prune_ratio", 0.0) or options.pop("beam_width", 1) != 1:
            raise ValueError("the disk backend scores all codes: it takes complexity only")
        books = pq.read_books(index.spark, f"{index.folder}/books")
        near = pq.shortlist(index.spark.read.parquet(f"{index.folder}/codes"), books, queries, max(complexity, k), m.metric, m.rows)
        if recompute:
            wanted = index.passages.select(F.col("pos").alias("id"), "text").join(near.select("id").distinct(), "id", "left_semi")
            data = embed.embed(wanted, model=m.embedding_model, mode=m.embedding_mode).drop("text")
        else:
            data = index.embeddings()
        return knn.rerank(near, data, queries, k, m.metric)


@register_backend("flat")
class FlatBackend(Backend):
    """Exact search; nothing to build."""

    def build(self, vectors: DataFrame, manifest: Manifest, path: str, passages: DataFrame) -> None:
        return None

    def search(self, index: Searcher, queries: DataFrame, k: int, recompute: bool, **options: Any) -> DataFrame:
        m = index.manifest
        if recompute:
            data = embed.embed(
                index.passages.select(F.col("pos").alias("id"), "text"), model=m.embedding_model, mode=m.embedding_mode
            ).drop("text")
        else:
            data = index.embeddings()
        return knn.exact_top_k(data, queries, k, m.metric, m.rows)


class Builder:
    """Collects documents, then writes an index."""

    def __init__(
        self, spark: SparkSession, backend: str = "graph", embedding_model: str = "64", embedding_mode: str = "hash", **options: Any
    ):
        if unknown := set(options) - OPTIONS - found_backend(backend).options:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        expected = default_metric(embedding_model, embedding_mode)
        chosen = options.pop("metric", expected)
        if expected == "cosine" and chosen != "cosine":
            warnings.warn(f"{embedding_model} returns unit vectors; cosine suits them better than {chosen}", stacklevel=2)
        recompute, compact = options.pop("is_recompute", True), options.pop("is_compact", True)
        if compact and not recompute:
            warnings.warn("without recomputation the vectors are kept, so the index isn't compact", stacklevel=2)
            compact = False
        self.spark = spark
        self.manifest = Manifest(
            backend, embedding_model, embedding_mode, 0, metric(chosen).name, 0, compact, recompute, backend_kwargs=options
        )
        self._texts: list[tuple[str, str | None, str]] = []
        self._frames: list[DataFrame] = []

    def add_text(self, text: str, metadata: dict[str, Any] | None = None) -> Builder:
        """One passage; its id is the metadata's ``id``, or its position."""
        held = metadata or {}
        self._texts.append((text, str(held["id"]) if "id" in held else None, json.dumps(held, ensure_ascii=False)))
        return self

    def add_documents(self, docs: DataFrame, id_column: str | None = None, text: str = "text") -> Builder:
        """Rows of a frame; their other columns become metadata."""
        others = [c for c in docs.columns if c not in (text, id_column)]
        packed = F.to_json(F.struct(*others)) if others else F.lit("{}")
        key = F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")
        self._frames.append(docs.select(F.col(text).alias("text"), key.alias("key"), packed.alias("meta")))
        return self

    def _passages(self) -> DataFrame:
        frames = list(self._frames)
        if self._texts:
            frames.insert(0, self.spark.createDataFrame(self._texts, "text string, key string, meta string"))
        if not frames:
            raise ValueError("there is nothing to index")
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        placed = passages.from_documents(rows.select("text", "key", "meta"))
        meta = F.try_variant_get("metadata", "$.meta", "string")
        key = F.coalesce(F.try_variant_get("metadata", "$.key", "string"), F.col("id"))
        return placed.select(key.alias("id"), "pos", "text", F.parse_json(F.coalesce(meta, F.lit("{}"))).alias("metadata"))

    def build(self, path: str, force: bool = False) -> Manifest:
        """Embed all texts and write the index; blank texts are left out."""
        held = self._write_passages(self._passages(), path, force)
        m = self.manifest
        vectors = embed.embed(
            held.select(F.col("pos").alias("id"), "text"), model=m.embedding_model, mode=m.embedding_mode
        ).select("id", "embedding")
        return self._finish(path, vectors, False)

    def build_from_embeddings(self, path: str, embeddings: DataFrame, texts: DataFrame | None = None, force: bool = False) -> Manifest:
        """From vectors (id, embedding); without texts (id, text), each passage names its id.  Counts have to agree."""
        dimension(embeddings)
        if not embeddings.where(~is_finite("embedding")).isEmpty():
            raise ValueError("some vectors hold components that aren't finite")
        named = passages.aligned(
            texts.select(F.col("id").cast("string").alias("id"), "text") if texts is not None else passages.placeholders(embeddings),
            embeddings
        )
        rows = passages.from_documents(named.select("id", "text"), "id")
        held = self._write_passages(rows, path, force)
        vectors = held.select("id", "pos").join(embeddings.select(F.col("id").cast("string").alias("id"), "embedding"), "id").select(
            F.col("pos").alias("id"), "embedding"
        )
        self.manifest = replace(self.manifest, is_compact=False, is_recompute=False)
        return self._finish(path, vectors, True)

    def _write_passages(self, rows: DataFrame, path: str, force: bool) -> DataFrame:
        store = Store(self.spark)
        if store.exists(f"{path}/manifest.json") and not force:
            raise FileExistsError(f"{path} holds an index; force rebuilds it")
        store.delete(f"{path}/manifest.json")
        rows.write.mode("overwrite").parquet(f"{path}/passages")
        held = self.spark.read.parquet(f"{path}/passages")
        n = held.count()
        if n == 0:
            raise ValueError("no text is left to index")
        if held.select("id").distinct().count() != n:
            raise ValueError("some ids occur more than once")
        self.manifest = replace(self.manifest, rows=n)
        return held

    def _finish(self, path: str, vectors: DataFrame, precomputed: bool) -> Manifest:
        vectors.write.mode("overwrite").parquet(f"{path}/embeddings")
        stored = self.spark.read.parquet(f"{path}/embeddings")
        self.manifest = replace(self.manifest, dimensions=dimension(stored), built_from_precomputed_embeddings=precomputed)
        try:
            found_backend(self.manifest.backend_name)().build(stored, self.manifest, path, self.spark.read.parquet(f"{path}/passages"))
        finally:
            # a pruned index keeps no vectors, whether its build succeeds or not
            if self.manifest.is_pruned:
                Store(self.spark).delete(f"{path}/embeddings")
        self.manifest.write(path, self.spark)
        register_project(os.getcwd())
        return self.manifest


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished index is there."""
    return Store(spark).exists(f"{path}/manifest.json")


class Searcher:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, path
        self.manifest = Manifest.read(path, spark)
        self.passages = spark.read.parquet(*self.manifest.passages_at(path))

    def embeddings(self) -> DataFrame:
        if self.manifest.is_pruned:
            raise RuntimeError("a pruned index has no vectors: search it with recomputation")
        return self.spark.read.parquet(f"{self.folder}/embeddings")

    def embed_queries(self, texts: list[str]) -> DataFrame:
        vectors = embed.compute(texts, self.manifest.embedding_model, self.manifest.embedding_mode)
        return self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, embedding array<float>")

    def search(
        self,
        texts: str | list[str],
        top_k: int = 5,
        complexity: int = 64,
        beam_width: int = 1,
        prune_ratio: float = 0.0,
        pruning_strategy: str = "global",
        recompute: bool | None = None,
        filters: dict[str, Any] | None = None
    ) -> DataFrame:
        """(qid, rank, id, score, text, metadata): the hits of each text, then those of them that meet ``filters``."""
        texts = [texts] if isinstance(texts, str) else texts
        k = min(top_k, self.manifest.rows)
        recompute = self.manifest.is_recompute if recompute is None else recompute
        options = {} if self.manifest.backend_name == "flat" else {
            "complexity": complexity, "beam_width": beam_width, "prune_ratio": prune_ratio, "strategy": pruning_strategy
        }
        hits = found_backend(self.manifest.backend_name)().search(self, self.embed_queries(texts), k, recompute, **options)
        found = hits.select("qid", "rank", F.col("id").alias("pos"), "score").join(self.passages, "pos").select(
            "qid", "rank", "id", "score", "text", "metadata"
        )
        return apply_filters(found, filters).orderBy("qid", "rank")


class Chat:
    """Answers from an index; borrows a searcher, or opens its own."""

    def __init__(self, spark: SparkSession, path: str, llm_config: dict[str, str] | None = None, searcher: Searcher | None = None):
        self.searcher = searcher or Searcher(spark, path)
        self.llm = rag.llm(llm_config)

    def ask(self, question: str, top_k: int = 5, llm_options: dict[str, Any] | None = None, **options: Any) -> str:
        hits = self.searcher.search(question, top_k, **options)
        asked = hits.sparkSession.createDataFrame([(0, question)], "qid long, question string")
        prompt = rag.prompts(rag.context(hits), asked).first()["prompt"]
        return self.llm.ask(prompt, **(llm_options or {}))


    def loop(self, lines: Iterable[str], say: Callable[[str], None] = print, **options: Any) -> int:
        """Answer line after line until one says quit, exit or q; blank ones are passed over.  How many were answered."""
        n = 0
        for text in map(str.strip, lines):
            if text.lower() in ("quit", "exit", "q"):
                break
            if text:
                say(self.ask(text, **options))
                n += 1
        return n


def registry_file() -> Path:
    return Path(os.environ.get("VECTRINE_HOME", Path.home() / ".vectrine")) / "projects.json"


def projects() -> list[str]:
    path = registry_file()
    return [p for p in json.loads(path.read_text()) if Path(p).is_dir()] if path.is_file() else []


def register_project(folder: str) -> None:
    """Remember a folder, once."""
    known, path = projects(), registry_file()
    if folder not in known:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps([*known, folder]))


def indexes(folders: list[str] | None = None) -> list[dict[str, Any]]:
    """Indexes below the folders: project, name, path, mb, passages and backend; each once."""
    found: dict[str, dict[str, Any]] = {}
    for project in folders if folders is not None else projects():
        for path in sorted(Path(project).rglob("manifest.json")):
            folder = path.parent
            try:
                m = Manifest.read(folder)
            except (TypeError, ValueError):
                continue
            size = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
            found.setdefault(
                str(folder.resolve()),
                {
                    "project": project,
                    "name": folder.name,
                    "path": str(folder),
                    "mb": size / 1048576,
                    "passages": m.rows,
                    "backend": m.backend_name
                }
            )
    return list(found.values())


def find(name: str, folders: list[str] | None = None) -> list[dict[str, Any]]:
    """Indexes by their own name or their folder's; the current project's first."""
    here = os.getcwd()
    hits = [i for i in indexes(folders) if name in (i["name"], Path(i["path"]).parent.name)]
    return sorted(hits, key=lambda i: (i["project"] != here, i["name"], i["path"]))


def remove(name: str, folders: list[str] | None = None, force: bool = False, confirm: str | None = None) -> str:
    """Delete the one index of that name.  Several are refused, with force too; without force, ``confirm`` has to repeat the name."""
    hits = find(name, folders)
    if not hits:
        raise FileNotFoundError(f"no index is named {name}")
    if len(hits) > 1:
        raise ValueError(f"{len(hits)} indexes are named {name}: " + ", ".join(i["path"] for i in hits))
    if not force and confirm != name:
        raise PermissionError("repeat the name to confirm")
    shutil.rmtree(hits[0]["path"])
    return hits[0]["path"]
