"""Text preparation: sanitising, chunking, language of code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import text, udfs

PROSE = ("\n\n", "\n", " ", "")
CODE = (*[f"\n{w}" for w in "class |def |async def |function |const |let |var |if |for |while |switch |try".split("|")], *PROSE)
LANGUAGES = (
    ("python", r"(?m)^\s*(def \w+\(|class \w+.*:|from [\w.]+ import |import \w+\s*$)"),
    ("go", r"(?m)^\s*(package \w+\s*$|func (\(\w+ \*?\w+\) )?\w+\()"),
    ("rust", r"(?m)^\s*(pub )?(fn \w+|struct \w+|impl\b|use [\w:]+;)"),
    ("java", r"(?m)^\s*(public|private|protected) (static |final )*(class|interface|void|[A-Z]\w*) "),
    ("cpp", r"(?m)^\s*#include\s*[<\"]"),
    ("typescript", r"(?m)^\s*(export )?(interface|type) \w+|:\s*(string|number|boolean)\b"),
    ("javascript", r"(?m)^\s*(function \w+\(|const \w+\s*=|let \w+\s*=|export )"),
    ("ruby", r"(?m)^\s*(module \w+|def \w+\s*$|end\s*$)"),
    ("php", r"<\?php"),
    ("csharp", r"(?m)^\s*(using [\w.]+;|namespace \w+)"),
    ("sql", r"(?im)^\s*(select\b.+\bfrom\b|create table\b|insert into\b)"),
)
_WORD = re.compile(r"\S+")


def word_length(piece: str) -> int:
    """The default measure of a chunk: white-space separated words."""
    return len(_WORD.findall(piece))


def sanitized(rows: DataFrame, column: str = "text", trusted: Column | None = None) -> DataFrame:
    """NFC, no zero-width signs or NULs, 16,000 characters at most; patterns are counted in the clipped text."""
    step = rows.withColumn("_nfc", udfs.nfc(column))
    bare = F.replace(F.regexp_replace("_nfc", text.ZERO_WIDTH, ""), F.lit("\x00"), F.lit(""))
    step = step.withColumn("clean", F.substring(bare, 1, text.MOST_CHARS)).withColumn("size_clipped", F.length(bare) > text.MOST_CHARS)
    count = text.injection_count(F.col("clean"))
    step = step.withColumn("patterns", count if trusted is None else F.when(trusted, 0).otherwise(count))
    return step.withColumn("normalized", ~F.col("_nfc").eqNullSafe(F.col(column))).withColumn("severity", text.severity(F.col("patterns"))).drop("_nfc")


def split(piece: str, size: int, overlap: int = 0, separators: tuple[str, ...] = PROSE, length: Callable[[str], int] = word_length) -> list[str]:
    """Recursive splitting: by the first separator that occurs, too long parts by the next; small parts are joined up to the size."""
    if not piece.strip():
        return []
    if length(piece) <= size:
        return [piece.strip()]
    separator = next(s for s in separators if s == "" or s in piece)
    rest = separators[separators.index(separator) + 1 :]
    if separator == "":
        step = max(1, len(piece) * size // max(length(piece), 1))
        parts = [piece[i : i + step] for i in range(0, len(piece), step)]
    else:
        head, *tail = piece.split(separator)
        keep = separator if separator.strip() else ""
        parts = [head, *[keep + t for t in tail]]
    glue = "" if separator == "" or separator.strip() else separator
    out, group, total = [], [], 0
    for part in parts:
        n = length(part)
        if n > size and rest:
            if group:
                out.append(glue.join(group))
            group, total = [], 0
            out.extend(split(part, size, overlap, rest, length))
            continue
        if group and total + n > size:
            out.append(glue.join(group))
            while group and (total > overlap or total + n > size):
                total -= length(group.pop(0))
        group.append(part)
        total += n
    if group:
        out.append(glue.join(group))
    return [x.strip() for x in out if x.strip()]


def clean(chunks: Column) -> Column:
    """Trimmed chunks, blank ones dropped."""
    return F.filter(F.transform(chunks, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def joined(left: Column, right: Column) -> Column:
    """Two units of code with one line break at least between them; an empty side adds nothing."""
    glue = F.when(left.endswith("\n") | right.startswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, glue, right))


def code_language(c: Column) -> Column:
    """The first language whose mark occurs; null for prose."""
    (first, pattern), *rest = LANGUAGES
    found = F.when(c.rlike(pattern), first)
    for name, pattern in rest:
        found = found.when(c.rlike(pattern), name)
    return found


def chunked(docs: DataFrame, size: int = 512, overlap: int = 0, code: bool = False, length: Callable[[str], int] = word_length) -> DataFrame:
    """(doc_id, chunk_index, content, chunk_hash) of every document, whole texts; code has no overlap."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is required")
    separators, overlap = (CODE, 0) if code else (PROSE, overlap)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split(content or "", size, overlap, separators, length)
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * len(found), pa.int64()), "chunk_index": pa.array(range(len(found)), pa.int32()), "content": found})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, "doc_id bigint, chunk_index int, content string").withColumn("chunk_hash", text.sha256_hex(F.col("content")))
