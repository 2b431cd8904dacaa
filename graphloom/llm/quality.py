"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams, the shapes of four successive characters
(case, digit, blank, kinds of signs), and marks for repeated words. A bounded
sample of labelled documents (``cap``) gives the term weights (tf-idf) and,
by truncated singular value decomposition, the latent-semantic space. The
labelled vectors are broadcast (their number is bounded); exact cosines of
every document with all of them are computed in blocks, and the ``k`` nearest
vote with their similarity as weight.

score = sum(similarity * label) / sum(similarity) over neighbours with a
positive similarity; a document is kept if the score is at least 0.5.

Defined results: a null or empty text has no terms: score 0, rejected. With no
labelled documents, or no neighbour of positive similarity, the score is 1
(nothing speaks against the document). A document isn't its own neighbour.
Similarities are rounded to 6 places; ties go to the smaller doc_id. Labels
that repeat count once, the larger one. Null doc_ids, repeated rows and other
columns pass through; an empty table gives no rows. Very long texts are read
in parts whose terms are added up, those across a cut too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _sample, _shared, _text

CAP = 3_000
K = 15
RANK = 48
TRIGRAMS = 1 << 10
SHAPES = 10**4
FOLDED = 1 << 10
MARKS = 4
WIDTH = TRIGRAMS + FOLDED + MARKS
DOCS = 512

_SHAPE = np.full(256, 9, np.int32)
_SHAPE[np.r_[97:123, 128:256]] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2
_SHAPE[[32, 9]] = 3
_SHAPE[[10, 13]] = 4
_SHAPE[[46, 44, 59, 58]] = 5
_SHAPE[[33, 63]] = 6
_SHAPE[[34, 39, 40, 41, 91, 93, 45]] = 7
_SHAPE[[124, 47, 92]] = 8


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # idf of each term
    space: np.ndarray  # term x rank
    vectors: np.ndarray  # labelled vectors, unit length
    labels: np.ndarray
    ids: np.ndarray
    k: int


def _terms(data: np.ndarray, starts: np.ndarray, owners: np.ndarray, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Part and term of every occurrence; ``memory`` holds the last two words of the block before."""
    lead = int(starts[0])
    part = np.r_[np.zeros(lead, np.int64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))]
    own = owners[part]
    parts, terms = [], []

    def grams(code: np.ndarray, n: int) -> None:
        begin = max(0, lead - n + 1)
        same = own[begin : len(data) - n + 1] == own[begin + n - 1 :]
        parts.append(part[begin : len(data) - n + 1][same])
        terms.append(code[begin:][same] * np.uint32(2654435769) >> np.uint32(32 - 10))

    if len(data) >= 3:
        fold = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        grams(fold[:-2] << np.uint32(16) | fold[1:-1] << np.uint32(8) | fold[2:], 3)
        terms[-1] = terms[-1].astype(np.int64)
    if len(data) >= 4:
        shape = _SHAPE[data]
        grams((((shape[:-3] * 10 + shape[1:-2]) * 10 + shape[2:-1]) * 10 + shape[3:]).astype(np.uint32), 4)
        terms[-1] = TRIGRAMS + terms[-1].astype(np.int64)
    begin, end, of = _text.word_spans(data[lead:], starts - lead)
    word = _text.span_hashes(data[lead:], begin, end)
    before = [h for o, h in memory.get("last", ()) if o == owners[0]]
    word = np.r_[np.array(before, np.uint64), word]
    of = np.r_[np.zeros(len(before), np.int64), of]
    for gap, mark in ((1, 0), (2, 1)):
        if len(word) > gap:
            again = (word[gap:] == word[:-gap]) & (owners[of[gap:]] == owners[of[:-gap]])
            again[: max(0, len(before) - gap)] = False
            parts.append(np.repeat(of[gap:][again], 20))
            terms.append(np.full(20 * int(again.sum()), TRIGRAMS + FOLDED + mark))
    if len(word):
        memory["last"] = list(zip(owners[of[-2:]].tolist(), word[-2:], strict=True))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(terms)


def counts(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(text)
    for rows, table in _sample.dense_blocks(_text.plain(text), _terms, WIDTH, 3):
        for row, line in zip(rows.tolist(), table, strict=True):
            at = np.flatnonzero(line)
            out[row] = at, line[at]
    return out


def _weighted(table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Terms as shares of the text, damped, so that length doesn't matter; unit length per kind of term."""
    share = np.sqrt(table / np.maximum(table[:, : TRIGRAMS].sum(1, keepdims=True), 1)) * weight
    for a, b in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + FOLDED)):
        share[:, a:b] /= np.maximum(np.linalg.norm(share[:, a:b], axis=1, keepdims=True), 1e-12)
    share[:, :TRIGRAMS] *= 0.4
    return share


def fit(docs: DataFrame, labels: DataFrame, cap: int = CAP, k: int = K, rank: int = RANK) -> Model:
    """Weights, space and labelled vectors from at most ``cap`` labelled documents."""
    rows = [r for r in _sample.counted(docs.select("doc_id", "text"), _sample.training_docs(docs, labels, "quality", cap), counts) if len(r[2])]
    held = np.bincount(np.concatenate([r[2] for r in rows]).astype(np.int64), minlength=WIDTH) if rows else np.zeros(WIDTH)
    weight = np.log((1 + len(rows)) / (1 + held)) + 0.2
    if not rows:
        return Model(weight, np.zeros((WIDTH, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64), k)
    x = np.empty((len(rows), WIDTH))
    for a in range(0, len(rows), DOCS):
        some = rows[a : a + DOCS]
        table = np.zeros((len(some), WIDTH))
        for i, r in enumerate(some):
            table[i, r[2]] = r[3]
        x[a : a + DOCS] = _weighted(table, weight)
    value, vector = np.linalg.eigh(x.T @ x)
    space = vector[:, ::-1][:, : min(rank, len(rows))]
    vectors = x @ space
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(weight, space, vectors, np.array([float(r[1]) for r in rows]), np.array([r[0] for r in rows], np.int64), k)


def _vote(vectors: np.ndarray, ids: np.ndarray, model: Model) -> np.ndarray:
    """Scores of unit vectors; ids: -1 for none."""
    if not len(model.ids):
        return np.ones(len(vectors))
    cosine = np.round(vectors @ model.vectors.T, 6)
    cosine[ids[:, None] == model.ids] = -2
    k = min(model.k, cosine.shape[1])
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
    above = cosine > least[:, None]
    tied = cosine == least[:, None]
    room = k - above.sum(1)
    nearest = above | (tied & (np.cumsum(tied, 1) <= room[:, None]))
    weight = np.where(nearest & (cosine > 0), cosine, 0.0)
    total = weight.sum(1)
    return np.where(total > 0, np.round((weight * model.labels).sum(1) / np.maximum(total, 1e-12), 6), 1.0)


def score(ids: pa.Array, text: pa.Array, model: Model) -> pa.StructArray:
    """quality_score and kept of each text."""
    number = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(text))
    for rows, table in _sample.dense_blocks(_text.plain(text), _terms, WIDTH, 3):
        for a in range(0, len(rows), DOCS):
            some = table[a : a + DOCS]
            vectors = _weighted(some, model.weight) @ model.space
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            out[rows[a : a + DOCS]] = np.where(some.any(1), _vote(vectors, number[rows[a : a + DOCS]], model), 0.0)
    return pa.StructArray.from_arrays([pa.array(out), pa.array(out >= 0.5)], ["quality_score", "kept"])


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<quality_score double, kept boolean>")
    def scored(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, text in columns:
            yield score(ids, text, shared.value)
            _shared.release()

    udf = scored.asNondeterministic()
    return lambda: udf(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, quality_score, kept) of every document."""
    model = model or fit(docs, labels)
    return docs.select("doc_id", _scorer(docs.sparkSession, model)().alias("found")).select("doc_id", "found.*")


def keep(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = model or fit(docs, labels)
    return docs.where(_scorer(docs.sparkSession, model)()["kept"])
