"""What Spark has no built-in for, as Arrow UDFs: a batch is one call."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

DIMENSIONS = 256
_BLOCK = 1_024
_WORD = re.compile(r"\w+")


def _each(f):
    return lambda column: pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    return _each(lambda x: unicodedata.normalize("NFC", x))(text)


@F.arrow_udf(StringType())
def casefold(text: pa.Array) -> pa.Array:
    return _each(str.casefold)(text)


@F.arrow_udf(StringType())
def title(text: pa.Array) -> pa.Array:
    """Title case at every border between letters and others."""
    return _each(str.title)(text)


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _key(name: str) -> str:
    return re.sub(r"[\s\-]", "", re.sub(r"^(the|a|an)\s+", "", _bare(name).lower().strip()))


@F.arrow_udf(StringType())
def strip_diacritics(text: pa.Array) -> pa.Array:
    return _each(_bare)(text)


@F.arrow_udf(StringType())
def compare_key(text: pa.Array) -> pa.Array:
    """Without marks, case, leading article, blanks and hyphens."""
    return _each(_key)(text)


def same_name(a: str, b: str, exact: bool = False, ratio: float = 0.8) -> bool:
    if not a or not b:
        return False
    x, y = _key(a), _key(b)
    return x == y or (not exact and difflib.SequenceMatcher(None, x, y).ratio() >= ratio)


@F.arrow_udf(BooleanType())
def fuzzy_match(a: pa.Array, b: pa.Array, exact: pa.Array) -> pa.Array:
    """Equal keys, or alike ones unless exactness is asked for."""
    return pa.array([same_name(x or "", y or "", bool(z)) for x, y, z in zip(a.to_pylist(), b.to_pylist(), exact.to_pylist(), strict=True)])


def embed(text: str, dimensions: int = DIMENSIONS, known: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    """Signed hashed bag of words of unit length; zeros without words."""
    known = {} if known is None else known
    vector = np.zeros(dimensions)
    for token in _WORD.findall(text.lower()):
        at = known.get(token)
        if at is None:
            digest = hashlib.sha256(token.encode()).digest()
            at = known[token] = int.from_bytes(digest[:4], "big") % dimensions, 1 if digest[4] % 2 == 0 else -1
        vector[at[0]] += at[1]
    length = np.linalg.norm(vector)
    return vector / length if length else vector


@F.arrow_udf(ArrayType(DoubleType()))
def hash_embedding(text: pa.Array) -> pa.Array:
    known: dict[str, tuple[int, int]] = {}
    rows = [None if x is None else embed(x, DIMENSIONS, known) for x in text.to_pylist()]
    return pa.array(rows, pa.list_(pa.float64()))


def similarity(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector; null for a null, a zero or a vector of another length. Rounded to 6 places."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf(DoubleType())
    def cosine(column: pa.Array) -> pa.Array:
        ok = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(q)) & column.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(column), np.nan)
        if ok.any():
            x = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            length = np.linalg.norm(x, axis=1)
            out[ok] = np.where(length > 0, np.round(x @ q / np.where(length > 0, length, 1), 6), np.nan)
        return pa.array(out, from_pandas=True)

    return cosine(embedding.cast("array<double>"))


def text_similarity(text: Column, query: Sequence[float]) -> Column:
    """``similarity`` of the hashed embedding of a text with a fixed vector: a number a row leaves the worker, not its vector."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf(DoubleType())
    def cosine(column: pa.Array) -> pa.Array:
        out, known = np.full(len(column), np.nan), {}
        for a in range(0, len(column) if len(q) == DIMENSIONS else 0, _BLOCK):
            rows = [_WORD.findall((x or "").lower()) for x in column[a : a + _BLOCK].to_pylist()]
            for token in {t for row in rows for t in row} - known.keys():
                digest = hashlib.sha256(token.encode()).digest()
                known[token] = int.from_bytes(digest[:4], "big") % DIMENSIONS, 1 if digest[4] % 2 == 0 else -1
            at = np.array([known[t] for row in rows for t in row], np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            x = np.bincount(row * DIMENSIONS + at[:, 0], at[:, 1], len(rows) * DIMENSIONS).reshape(len(rows), DIMENSIONS)
            length = np.linalg.norm(x, axis=1)
            out[a : a + len(rows)] = np.where(length > 0, np.round(x @ q / np.where(length > 0, length, 1), 6), np.nan)
        return pa.array(out, from_pandas=True)

    return cosine(text)


def cosine_expression(a: Column, b: Column) -> Column:
    """Cosine of two columns in the JVM; 0 where a vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda i, j: i * j), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))
