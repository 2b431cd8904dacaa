"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the average of the embeddings of its hashed byte n-grams (within
words, blanks marking their ends); a linear softmax gives the languages. Both
are trained by stochastic gradient descent in numpy on a bounded sample
(``cap`` labelled documents). A held-out fifth sets the softmax temperature
and the rejection rule: a document is accepted if its calibrated probability
reaches the lowest threshold (0.5 at least) at which accepted held-out
documents err at most ``risk`` of the time, and if enough of its n-grams were
seen in training.

Every document is scored over its whole text; as the model is linear, n-gram
embeddings are multiplied with the softmax once, before the scan.

Defined results: null and empty texts, and texts without letters, have no
n-grams: language null, confidence 0, rejected. With no labelled document
everything is rejected; with one language only coverage rejects. Ties take the
first language in alphabetical order. Repeated rows are scored each time; a
null doc_id is kept; other columns pass through ``keep`` untouched; an empty
table gives no rows. Very long texts are read in parts, and no n-gram is lost
between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _sample, _shared, _text

BITS = 14
GRAMS = (3, 4)
DIMENSIONS = 16
CAP = _sample.CAP
RISK = 0.01

_FOLD = np.where(_text.WORD_BYTE, np.arange(256), 32).astype(np.uint32)
_FOLD[48:58] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times softmax
    bias: np.ndarray
    seen: np.ndarray
    temperature: float
    confidence: float
    coverage: float


def _buckets(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the n-grams inside words, one blank allowed at either end."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    byte = _FOLD[data]
    m = len(data) - n + 1
    code = np.zeros(m, np.uint32)
    good = np.ones(m, bool)
    letter = byte != 32
    for i in range(n):
        code = (code << np.uint32(8)) | byte[i : m + i]
        if 0 < i < n - 1:
            good &= letter[i : m + i]
    at = np.flatnonzero(good)
    return at, (code[at] * np.uint32(2654435769) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def _all(data: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bounds of the parts in the buckets, buckets); n-grams that run into the next document are left out."""
    goes_on = owners[1:] == owners[:-1]
    for n in GRAMS:
        at, bucket = _buckets(data, n)
        begin, end = starts[:-1].copy(), starts[1:] - n + 1
        begin[0] = max(0, begin[0] - n + 1)  # across the cut, if the first part goes on with a document
        end[:-1][goes_on] += n - 1
        first = np.searchsorted(at, begin)
        last = np.maximum(np.searchsorted(at, end), first)
        yield np.stack([first, last], 1), bucket


def counts(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    total = [[] for _ in range(len(text))]
    for data, starts, owners in _text.blocks(_text.plain(text, lower=True), lap=max(GRAMS) - 1):
        for bounds, bucket in _all(data, starts, owners):
            for (a, b), owner in zip(bounds.tolist(), owners.tolist(), strict=True):
                total[owner].append(bucket[a:b])
    return [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for x in total]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, cap: int = CAP, epochs: int = 6, rate: float = 2.0, batch: int = 32, risk: float = RISK, seed: int = 7) -> Model:
    """Train on at most ``cap`` documents whose ``lang`` isn't null."""
    _shared.require(docs, "doc_id", "text", "lang")
    chosen = _sample.bounded(docs.select("doc_id", "lang"), F.col("lang"), cap)
    rows = [r for r in _sample.counted(docs.select("doc_id", "text"), chosen, counts) if len(r[2])]
    languages = sorted({r[1] for r in rows})
    size = 1 << BITS
    if not languages:
        return Model([], np.zeros((size, 0)), np.zeros(0), np.zeros(size, bool), 1.0, 2.0, 2.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    train = order[len(rows) // 5 :]
    y = np.array([languages.index(r[1]) for r in rows])

    def matrix(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), size), np.float32)
        for i, k in enumerate(some.tolist()):
            x[i, rows[k][2]] = rows[k][3] / rows[k][3].sum()
        return x

    embedding = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    seen = np.zeros(size, bool)
    for k in train.tolist():
        seen[rows[k][2]] = True
    steps = epochs * -(-len(train) // batch)
    step = 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for a in range(0, len(mixed), batch):
            some = mixed[a : a + batch]
            now = rate * (1 - step / steps)
            step += 1
            features = np.unique(np.concatenate([rows[k][2] for k in some.tolist()]))
            x = np.zeros((len(some), len(features)), np.float32)
            for i, k in enumerate(some.tolist()):
                x[i, np.searchsorted(features, rows[k][2])] = rows[k][3] / rows[k][3].sum()
            hidden = x @ embedding[features]
            p = _softmax(hidden @ softmax + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = x.T @ (p @ softmax.T)
            softmax -= now * (hidden.T @ p)
            bias -= now * p.sum(0)
            embedding[features] -= now * len(features) ** 0.5 * back
    table = embedding.astype(np.float64) @ softmax.astype(np.float64)
    if len(held) < 10:
        return Model(languages, table, bias.astype(np.float64), seen, 1.0, 0.5, 0.0)
    logits = np.concatenate([matrix(held[i : i + 256]).astype(np.float64) @ table for i in range(0, len(held), 256)]) + bias
    grid = np.geomspace(0.05, 20, 121)
    truth = y[held]
    temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean()))
    p = _softmax(logits / temperature)
    wrong, best = p.argmax(1) != truth, p.max(1)
    down = np.argsort(-best, kind="stable")
    safe = np.cumsum(wrong[down]) <= risk * np.arange(1, len(down) + 1)
    confidence = max(0.5, float(best[down[np.flatnonzero(safe)[-1]]]) if safe.any() else 1.0)
    confidence = 0.5 if safe.all() else confidence
    cover = np.array([rows[k][3][seen[rows[k][2]]].sum() / rows[k][3].sum() for k in held.tolist()])
    return Model(languages, table, bias.astype(np.float64), seen, temperature, confidence, float(np.quantile(cover, 0.001)) / 2)


def score(text: pa.Array, model: Model) -> pa.StructArray:
    """lang, confidence, coverage, accepted of each text."""
    n, width = len(text), len(model.languages)
    table = np.concatenate([model.table, model.seen[:, None], np.ones((len(model.seen), 1))], 1)
    total = np.zeros((n, width + 2))
    for data, starts, owners in _text.blocks(_text.plain(text, lower=True), lap=max(GRAMS) - 1):
        for bounds, bucket in _all(data, starts, owners):
            some = np.flatnonzero(bounds[:, 1] > bounds[:, 0])
            if len(some):
                flat = bounds[some].ravel()
                values = table[np.append(bucket, 0)]
                np.add.at(total, owners[some], np.add.reduceat(values, flat, axis=0)[::2])
    grams = total[:, -1]
    has = (grams > 0) & (width > 0)
    mean = total[:, :-1] / np.maximum(grams, 1)[:, None]
    p = _softmax((mean[:, :width] + model.bias) / model.temperature) if width and n else np.zeros((n, 1))
    confidence = np.where(has, np.round(p.max(1), 6), 0.0) if n else np.zeros(0)
    coverage = np.round(mean[:, width], 6)
    accepted = has & (confidence >= model.confidence) & (coverage >= model.coverage)
    best = np.round(p, 9).argmax(1) if n else np.zeros(0, int)
    names = pa.array([model.languages[k] if ok else None for k, ok in zip(best.tolist(), has.tolist(), strict=True)], pa.string())
    return pa.StructArray.from_arrays([names, pa.array(confidence), pa.array(coverage), pa.array(accepted)], ["lang", "confidence", "coverage", "accepted"])


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, confidence double, coverage double, accepted boolean>")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield score(text, shared.value)
            _shared.release()

    return scored.asNondeterministic()


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, coverage, accepted) of every document."""
    _shared.require(docs, "doc_id", "text")
    model = model or fit(docs)
    return docs.select("doc_id", _scorer(docs.sparkSession, model)(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are accepted, with all their columns."""
    model = model or fit(docs)
    return docs.where(_scorer(docs.sparkSession, model)(F.col("text").cast("string"))["accepted"])
