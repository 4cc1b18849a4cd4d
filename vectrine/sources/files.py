"""Files and folders as documents (file_path, file_name, extension, size, text)."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import uuid
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.schema import Store
from vectrine.storage import written

TEXT_EXTENSIONS = tuple(
    ".txt .md .markdown .rst .tex .csv .tsv .json .jsonl .yaml .yml .toml .ini .cfg .conf .xml .html .htm .css .scss .log .py .ipynb .r .rb .java .kt .scala .js .jsx .ts .tsx .vue .c .h .cpp .hpp .cc .cs .go .rs .swift .php .pl .lua .sh .bash .sql .docx .pptx".split()
)
CODE_EXTENSIONS = tuple(".py .java .js .jsx .ts .tsx .cs .c .h .cpp .hpp .go .rs .rb .php .swift .kt .scala .sh .sql .r".split())
EXCLUDED_FOLDERS = (
    ".git",
    "__pycache__",
    "node_modules",
    "venv",
    ".venv",
    "env",
    "build",
    "dist",
    "target",
    ".idea",
    ".vscode",
    ".mypy_cache",
    ".pytest_cache"
)
MAX_CODE_BYTES = 1_000_000
SCHEMA = "file_path string, file_name string, extension string, size long, text string"


def parse_extensions(wanted: str | None) -> list[str] | None:
    """``".txt,pdf"`` -> ``[".txt", ".pdf"]``."""
    if not wanted:
        return None
    return [e if e.startswith(".") else f".{e}" for e in (part.strip().lower() for part in wanted.split(",")) if e]


def is_hidden(path: Column) -> Column:
    """Some part of the path starts with a dot, other than ``.`` and ``..``."""
    return path.rlike(r"(^|/)\.(?!\.?(/|$))[^/]*")


def in_folder(path: Column, names: tuple[str, ...] = EXCLUDED_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def ignore_rules(root: str | Path) -> list[str]:
    """Patterns of a folder's .gitignore, or else of folders that are never wanted."""
    path = Path(root, ".gitignore")
    if path.is_file():
        return [line.strip() for line in path.read_text(errors="ignore").splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return [f"{name}/" for name in (".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist")] + [".DS_Store", "*.pyc"]


def is_ignored(relative: str, rules: list[str]) -> bool:
    """By rules in the manner of .gitignore; the last one that fits decides, and ``!`` takes back."""
    parts, ignored = relative.split("/"), False
    for rule in rules:
        back, body = rule.startswith("!"), rule.lstrip("!")
        only_folder, anchored = body.endswith("/"), "/" in body.rstrip("/")
        body = body.strip("/")
        folders = ["/".join(parts[: i + 1]) for i in range(len(parts) - (1 if only_folder else 0))]
        if any(fnmatch.fnmatch(f, body) if anchored else fnmatch.fnmatch(f.rsplit("/", 1)[-1], body) for f in folders):
            ignored = not back
    return ignored


def submodules(root: str | Path) -> list[str]:
    """Paths of git submodules below ``root``, as .gitmodules names them."""
    path = Path(root, ".gitmodules")
    if not path.is_file():
        return []
    return [line.split("=", 1)[1].strip() for line in path.read_text(errors="ignore").splitlines() if line.strip().startswith("path")]


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _on_disk(root: str) -> str | None:
    """The path of a root in the local file system, which Python reads itself; None for others."""
    if root.startswith("file:"):
        return re.sub("^file:/+", "/", root)
    return None


def _walked(root: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files below a local folder, links followed; what goes meanwhile, and checksum files, are left out."""
    if os.path.isfile(root):
        yield root, os.path.getsize(root)
        return
    waiting = [root]
    while waiting:
        with os.scandir(waiting.pop()) as entries:
            for entry in entries:
                try:
                    if entry.is_dir():
                        waiting.append(entry.path)
                    elif not (entry.name.startswith(".") and entry.name.endswith(".crc")):
                        yield entry.path, entry.stat().st_size
                except FileNotFoundError:
                    continue


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, relative) of the files below ``root``, or of the one file; names only, no content is read.

    The file system's own recursive listing is streamed; names are all that the driver sees.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(at).toString().rstrip("/")
    local = _on_disk(base)
    if local is not None:
        found = ((f"file:{path}", size) for path, size in _walked(local))
    else:
        found = _remote(system, at)
    rows = [(path, size, path[len(base) + 1 :] or path.rsplit("/", 1)[-1]) for path, size in found]
    paths, sizes, names = zip(*rows) if rows else ((), (), ())
    kinds = zip((paths, sizes, names), (pa.string(), pa.int64(), pa.string()))
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in kinds], ["path", "size", "relative"]))


def _remote(system, at) -> Iterator[tuple[str, int]]:
    entries = system.listFiles(at, True)
    while entries.hasNext():
        status = entries.next()
        yield status.getPath().toString(), status.getLen()


def write_lines(rows: DataFrame, key: str, text: str, folder: str) -> None:
    """A folder ``key=...`` below ``folder`` with a file for each of ``rows``, unique by ``key``; the text ends with a line feed.

    Local files are written by Python: the file system of Hadoop runs a program for each one's permissions.
    """
    local = _on_disk(folder)
    if local is None:
        rows.select(key, F.col(text).alias("value")).write.partitionBy(key).text(folder)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = os.path.join(local, f"{key}={name}")
                os.makedirs(own, exist_ok=True)
                # a task that runs twice puts the same whole file in place
                part = os.path.join(own, f".{uuid.uuid4().hex}")
                with open(part, "wb") as file:
                    file.write((value.as_py() or "").encode() + b"\n")
                os.replace(part, os.path.join(own, "part.txt"))
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    os.makedirs(local, exist_ok=True)
    rows.select(F.col(key).cast("string"), text).mapInArrow(run, "files long").agg(F.sum("files")).first()


#: Files a task, and bytes that a batch of contents holds about.
FILES_PER_TASK, BATCH_BYTES = 2_000, 16_000_000


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contents of local files beside their names; memory holds a few MB, or one file that is larger."""
    for batch in batches:
        held, size, low = [], 0, 0
        for i, path in enumerate(batch.column(0).to_pylist()):
            with open(_on_disk(path), "rb") as file:
                held.append(file.read())
            size += len(held[-1])
            if size >= BATCH_BYTES or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([*batch.slice(low, len(held)).columns, pa.array(held, pa.binary())], _HELD)
                held, size, low = [], 0, i + 1


_HELD = ["path", "file_name", "extension", "size", "content"]


def read(
    spark: SparkSession,
    paths: list[str],
    extensions: list[str] | None = None,
    include_hidden: bool = False,
    max_bytes: int | None = None,
    excluded: tuple[str, ...] = ()
) -> DataFrame:
    """Documents of files and of folders, searched through.  What doesn't exist is left out with a warning.

    Folders are listed first and names filtered; the contents of the files that are left are all that is read.  Undecodable bytes become
    replacement characters; PDF needs an optional parser.
    """
    wanted = [e.lower() for e in extensions] if extensions else [*TEXT_EXTENSIONS, ".pdf"]
    frames = []
    for root in paths:
        if not Store(spark).exists(root):
            warnings.warn(f"{root} does not exist", stacklevel=2)
            continue
        local = root.removeprefix("file://")
        rows = listed(spark, root).withColumn("file_name", F.element_at(F.split("relative", "/"), -1))
        rows = rows.withColumn("extension", F.lower(F.regexp_extract("file_name", r".(\.[^.]+)$", 1)))
        if not os.path.isfile(local):
            rows = rows.where(F.col("extension").isin(wanted))
            if not include_hidden:
                rows = rows.where(~is_hidden(F.col("relative")))
            rules, skipped = ignore_rules(local), submodules(local)
            ignored = F.pandas_udf(
                lambda s: s.map(lambda r: is_ignored(r, rules) or any(r == m or r.startswith(m + "/") for m in skipped)), "boolean"
            )
            rows = rows.where(~ignored("relative"))
            if excluded:
                rows = rows.where(~in_folder(F.col("relative"), excluded))
        if max_bytes is not None:
            rows = rows.where(F.col("size") <= max_bytes)
        frames.append(rows)
    if not frames:
        return spark.createDataFrame([], SCHEMA)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    kept = out.select("path", "file_name", "extension", "size").dropDuplicates(["path"])
    kept = written(kept, "listed")
    count, here = kept.agg(F.count(F.lit(1)), F.bool_and(F.startswith("path", F.lit("file:")))).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    if here:
        # Spark would look up each path of a list, and open few files a task
        tasks = max(-(-count // FILES_PER_TASK), min(count, spark.sparkContext.defaultParallelism))
        kind = "path string, file_name string, extension string, size long, content binary"
        held = kept.repartition(tasks, "path").mapInArrow(_opened, kind)
    else:
        chosen = [r["path"] for r in kept.select("path").toLocalIterator()]
        held = spark.read.format("binaryFile").load([_escaped(p) for p in chosen]).select("path", "content").join(kept, "path")
    return held.select(_local(F.col("path")).alias("file_path"), "file_name", "extension", "size", "content").mapInArrow(_decoded, SCHEMA)


def _escaped(path: str) -> str:
    """A path whose own characters aren't taken for a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def read_code(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] = CODE_EXTENSIONS,
    excluded: tuple[str, ...] = EXCLUDED_FOLDERS,
    max_bytes: int = MAX_CODE_BYTES
) -> DataFrame:
    """Source files of a repository, without excluded folders and files over ``max_bytes``."""
    return read(spark, [root], list(extensions), max_bytes=max_bytes, excluded=excluded)


def extensions_of(documents: DataFrame) -> DataFrame:
    """(extension, files) in order of extension."""
    return documents.groupBy("extension").agg(F.count(F.lit(1)).alias("files")).orderBy("extension")


def _by_fitz(content: bytes) -> str:
    import fitz  # optional

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _by_plumber(content: bytes) -> str:
    import pdfplumber  # optional

    with pdfplumber.open(io.BytesIO(content)) as doc:
        return "\n".join(page.extract_text() or "" for page in doc.pages)


def _by_pypdf(content: bytes) -> str:
    import pypdf  # optional

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


#: Tried in turn; the first that gives text decides.
PDF_READERS = [_by_fitz, _by_plumber, _by_pypdf]


def pdf_text(content: bytes) -> str | None:
    """By PyMuPDF, else pdfplumber, else pypdf; None where none is installed or can read it."""
    for reader in PDF_READERS:
        try:
            if (text := reader(content)).strip():
                return text
        except Exception:  # a missing package, or a file that it can't read
            continue
    return None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            pdf_text(c) if e == ".pdf" else (c or b"").decode("utf-8", "replace") for e,
            c in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(texts, pa.string())], ["file_path", "file_name", "extension", "size", "text"]
        )
