"""Vectors computed elsewhere: pairs of an id array and a matrix, as numpy writes them."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unpacked(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` and ``embeddings`` of an .npz archive; they have to agree in length, and nothing in it is unpickled."""
    with np.load(io.BytesIO(content), allow_pickle=False) as held:
        if {"ids", "embeddings"} - set(held.files):
            raise ValueError("an archive of vectors holds ids and embeddings")
        ids, matrix = held["ids"], held["embeddings"]
    if matrix.ndim != 2 or ids.ndim != 1 or len(ids) != len(matrix):
        raise ValueError(f"{ids.shape} ids don't fit {matrix.shape} vectors")
    return ids, matrix


def packed(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, embeddings=matrix)
    return out.getvalue()


def from_archives(archives: DataFrame) -> DataFrame:
    """(id as text, embedding) of a column ``content`` of .npz archives; each is unpacked in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ids, matrix = unpacked(content.as_py())
                for low in range(0, len(ids), 4096):
                    rows = matrix[low : low + 4096].astype(np.float32)
                    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([str(i) for i in ids[low : low + 4096].tolist()]),
                            pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))
                        ],
                        ["id", "embedding"]
                    )

    return archives.select("content").mapInArrow(run, "id string, embedding array<float>")


def to_archives(vectors: DataFrame, per_archive: int = 4096) -> DataFrame:
    """``content``: vectors (id long, embedding) as .npz archives, cut by the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), per_archive):
                part = batch.slice(low, per_archive)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([pa.array([packed(part.column(0).to_numpy(), matrix)], pa.binary())], ["content"])

    return vectors.select("id", "embedding").mapInArrow(run, "content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of the .npz archives below ``path``; vectors of several dimensions are refused by ``vector.dimension``."""
    return from_archives(
        spark.read.format("binaryFile").option(
            "recursiveFileLookup", True
        ).option("pathGlobFilter", "*.npz").load(path).select(F.col("content"))
    )
