"""Schemas of datasets, and the index manifest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

PASSAGE = "id string, pos long, text string, metadata variant"
EMBEDDING = "id string, embedding array<float>"
GRAPH = "shard int, node long, level int, neighbors array<long>, centre array<float>"
HIT = "qid long, id long, score double, rank long"
HISTORY = "last_visit_time long, url string, title string, visit_count int, typed_count int, hidden int"
MESSAGE = "content variant, message string, createTime long, fromUser string, toUser string, isSentFromSelf boolean"


class Store:
    """Files of any store that Spark knows: what Hadoop's file systems offer, for small files and folders."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self.jvm.org.apache.hadoop.fs.Path(str(path))
        return found.getFileSystem(self.conf), found

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return bool(system.exists(at))

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)

    def rename(self, old: str, new: str) -> None:
        system, at = self._at(old)
        if not system.rename(at, self._at(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def write(self, path: str, text: str) -> None:
        system, at = self._at(path)
        out = system.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        system, at = self._at(path)
        stream = system.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


@dataclass
class Manifest:
    """Beside an index's datasets; written last, so an index without one isn't finished."""

    backend_name: str = "graph"
    embedding_model: str = "64"
    embedding_mode: str = "hash"
    dimensions: int = 0
    metric: str = "mips"
    rows: int = 0
    is_compact: bool = True
    is_recompute: bool = True
    built_from_precomputed_embeddings: bool = False
    version: str = "1"
    backend_kwargs: dict[str, Any] = field(default_factory=dict)
    passage_sources: list[dict[str, str]] = field(default_factory=lambda: [{"type": "parquet", "path": "passages"}])

    @property
    def is_pruned(self) -> bool:
        return self.is_compact and self.is_recompute

    def write(self, folder: str | Path, spark: SparkSession | None = None) -> None:
        text = json.dumps({**asdict(self), "is_pruned": self.is_pruned}, indent=2, ensure_ascii=False)
        if spark is not None:
            Store(spark).write(f"{folder}/manifest.json", text)
        else:
            Path(folder, "manifest.json").write_text(text)

    @classmethod
    def read(cls, folder: str | Path, spark: SparkSession | None = None) -> Manifest:
        path = f"{folder}/manifest.json"
        if not (Store(spark).exists(path) if spark is not None else Path(path).is_file()):
            raise FileNotFoundError(f"no index at {folder}: manifest.json is missing")
        held = json.loads(Store(spark).read(path) if spark is not None else Path(path).read_text())
        held.pop("is_pruned", None)
        return cls(**held)

    def passages_at(self, folder: str | Path) -> list[str]:
        """Places of the passage datasets: as they stand if absolute, else beside the manifest, else under the working directory, else the source's
        ``path_relative`` beside the manifest, else ``passages`` there."""
        out = []
        for source in self.passage_sources:
            path = Path(source["path"])
            if "://" in str(folder):
                out.append(source["path"] if "://" in source["path"] else f"{folder}/{source.get('path_relative') or source['path']}")
                continue
            tried = [path] if path.is_absolute() else [Path(folder, path), path.resolve()]
            if source.get("path_relative"):
                tried.append(Path(folder, source["path_relative"]))
            tried += [Path(folder, path.name), Path(folder, "passages")]
            out.append(str(next((p for p in tried if p.exists()), tried[0])))
        return out
