"""Chunkers: windows of words or characters, sentence packing, and code by top-level nodes."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGE_OF = {
    ".py": "python", ".java": "java", ".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"
}
BRACES = ("java", "csharp", "typescript")
#: source -> (size, overlap)
PROFILES = {
    "text": (256, 128),
    "code": (512, 64),
    "code_lines": (512, 50),
    "email": (256, 25),
    "browser": (256, 128),
    "chat": (192, 64),
    "code_fallback": (256, 64)
}


def checked(size: int, overlap: int, halve: bool = False) -> tuple[int, int]:
    """A usable window: sizes below 1 become 256; an overlap as large as the window shrinks to size - 1, or to half."""
    size = size if size > 0 else 256
    overlap = max(0, overlap)
    return size, overlap if overlap < size else size // 2 if halve else size - 1


def _with_chunks(batch: pa.RecordBatch, text: str, rows: list[int], numbers: list[int], chunks: pa.Array) -> pa.RecordBatch:
    """The other columns of a batch, repeated for each chunk."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in (text, "chunk_no", "chunk")]
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i).take(at) for i in kept), pa.array(numbers, pa.int64()), chunks],
        [*(batch.schema.names[i] for i in kept), "chunk_no", "chunk"]
    )


def _chunk_schema(docs: DataFrame, text: str) -> T.StructType:
    kept = [f for f in docs.schema.fields if f.name not in (text, "chunk_no", "chunk")]
    return T.StructType([*kept, T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.StringType())])


def word_windows(docs: DataFrame, size: int = 256, overlap: int = 128, text: str = "text") -> DataFrame:
    """A row for each window of words ``[^\\x20\\x09-\\x0D]+``: all columns of ``docs`` but the text, with chunk_no and chunk; blank texts give none.

    The last window is the first that reaches the end.  A text is split once, in Arrow batches.  Columns named chunk_no or chunk are replaced.
    """
    size, overlap = checked(size, overlap)
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, chunks = [], [], []
            for i, body in enumerate(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())):
                words = (body.as_py() or b"").split()
                if words:
                    n = max(0, -(-(len(words) - size) // step)) + 1
                    rows += [i] * n
                    numbers += range(n)
                    chunks += [b" ".join(words[at : at + size]) for at in range(0, n * step, step)]
            yield _with_chunks(batch, text, rows, numbers, pa.array(chunks, pa.binary()).cast(pa.string()))

    return docs.mapInArrow(run, _chunk_schema(docs, text))


def char_windows(docs: DataFrame, size: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """As ``word_windows``, over characters."""
    size, overlap = checked(size, overlap)
    step = size - overlap
    held = docs.where(F.length(text) > 0)
    starts = F.expr(f"sequence(0, greatest(0, cast(ceil((length({text}) - {size}) / {step}) as int)) * {step}, {step})")
    return held.select("*", F.posexplode(starts).alias("chunk_no", "_at")).withColumn(
        "chunk", F.expr(f"substring({text}, _at + 1, {size})")
    ).withColumn("chunk_no", F.col("chunk_no").cast("long")).drop("_at", text)


def drop_blank(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks with a character other than white space."""
    return chunks.where(F.col(text).isNotNull() & (F.regexp_replace(text, "(?U)\\s+", "") != ""))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


def with_language(docs: DataFrame, path: str = "file_path", languages: dict[str, str] | None = None) -> DataFrame:
    """Adds ``extension``, ``language`` (null for text) and ``is_code``; ``languages`` overrides the table."""
    table = {**LANGUAGE_OF, **(languages or {})}
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    out = docs.withColumn("extension", extension(F.col(path))).withColumn("language", F.try_element_at(known, F.col("extension")))
    return out.withColumn("is_code", F.col("language").isNotNull())


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def pack_sentences(text: str, size: int = 256, overlap: int = 128) -> list[str]:
    """Whole sentences up to ``size`` words a chunk, carrying at most ``overlap`` words on; longer sentences are cut into windows."""
    size, overlap = checked(size, overlap, halve=True)
    chunks: list[str] = []
    current: list[list[str]] = []
    held = 0
    for sentence in _SENTENCE.split(text or ""):
        tokens = sentence.split()
        for part in (tokens[i : i + size] for i in range(0, len(tokens), size)):
            n = len(part)
            if current and held + n > size:
                chunks.append(" ".join(w for s in current for w in s))
                while current and (held > overlap or held + n > size):
                    held -= len(current.pop(0))
            current.append(part)
            held += n
    if current:
        chunks.append(" ".join(w for s in current for w in s))
    return chunks


_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def brace_units(source: str, depth: int = 0) -> list[str]:
    """Parts of a source in a language of braces, cut where a declaration at ``depth`` ends: after its closing brace, or its semicolon.

    Braces in comments, texts and characters don't count.  What stands between two declarations (comments, annotations) belongs to the later one.
    """
    # the same length, with what is quiet blanked out
    bare = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    cuts, level, round_ = [0], 0, 0
    for m in re.finditer(r"[{}();]", bare):
        c = m.group()
        round_ += (c == "(") - (c == ")")
        level += (c == "{") - (c == "}")
        if (c == "}" and level == depth or c == ";" and level == depth) and round_ <= 0:
            # the rest of the line goes along, such as a comment or `});`
            end = bare.find("\n", m.end())
            end = len(source) if end < 0 else end + 1
            if not bare[m.end() : end].strip(" \t\n;,)"):
                cuts.append(end)
    cuts.append(len(source))
    cuts = sorted(set(cuts))
    return [source[a:b] for a, b in zip(cuts, cuts[1:])]


def _fitting(unit: str, size: int, depth: int) -> list[str]:
    """A declaration, or if it is larger than ``size`` those within it, as deep as there are any."""
    if len(unit) <= size or depth > 3:
        return [unit]
    parts = brace_units(unit, depth + 1)
    return [unit] if len(parts) < 2 else [p for part in parts for p in _fitting(part, size, depth + 1)]


def _python_units(source: str, lines: list[str]) -> list[str]:
    nodes = ast.parse(source).body
    starts = sorted({0, *(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in nodes)}) or [0]
    return ["".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)])]


def split_code(source: str, language: str | None, size: int = 512, overlap: int = 64) -> list[str]:
    """Declarations packed up to ``size`` characters: Python by its syntax tree, languages of braces by theirs; anything else, and what doesn't
    parse, by lines, of which the last ``overlap`` characters are repeated."""
    if not source.strip():
        return []
    lines = source.splitlines(keepends=True)
    units, by_lines = lines, True
    if language == "python":
        try:
            units, by_lines = _python_units(source, lines), False
        except SyntaxError:
            pass
    elif language in BRACES:
        found = [p for unit in brace_units(source) for p in _fitting(unit, size, 0)]
        if len(found) > 1 or len(source) <= size:
            units, by_lines = found, False
    chunks, current = [], ""
    for unit in units:
        if current and len(current) + len(unit) > size:
            chunks.append(current)
            current = current[-overlap:] if overlap and by_lines and len(current[-overlap:]) + len(unit) <= size else ""
        current += unit
    chunks.append(current)
    return [c.strip() for c in chunks if c.strip()]


def use_tokens(count: Callable[[str], list], text: str, size: int, overlap: int) -> list[str]:
    """Windows of tokens in place of words: ``count`` cuts a text into pieces that join to it again, such as those of a tokenizer."""
    pieces = count(text)
    size, overlap = checked(size, overlap)
    starts = range(0, max(1, len(pieces) - overlap), size - overlap)
    return [c for at in starts if (c := "".join(pieces[at : at + size]).strip())]


def chunk_documents(
    docs: DataFrame,
    text: str = "text",
    path: str = "file_path",
    text_profile: tuple[int, int] = PROFILES["text"],
    code_profile: tuple[int, int] = PROFILES["code"],
    use_ast: bool = True
) -> DataFrame:
    """Routes code and prose to their chunkers and keeps the other columns; a failing chunker falls back to sentences, then to the text."""
    routed = with_language(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            for i, (body, language) in enumerate(
                zip(
                    batch.column(batch.schema.get_field_index(text)).to_pylist(),
                    batch.column(batch.schema.get_field_index("language")).to_pylist()
                )
            ):
                body = body or ""
                try:
                    parts = split_code(body, language, *code_profile) if language and use_ast else pack_sentences(body, *text_profile)
                except Exception:
                    parts = [body] if body.strip() else []
                rows += [(i, n, part) for n, part in enumerate(parts)]
            yield _with_chunks(batch, text, [r[0] for r in rows], [r[1] for r in rows], pa.array([r[2] for r in rows], pa.string()))

    return routed.mapInArrow(run, _chunk_schema(routed, text))
