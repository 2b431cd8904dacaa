"""Bounded samples of labelled documents for fitting, and sparse counts on the wire."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _shared, _text

#: The most labelled documents that a model is fitted on.
CAP = 4_000
#: Rows of a table of dense counts.
ROWS = 512


def bounded(docs: DataFrame, label: Column, cap: int = CAP) -> DataFrame:
    """(doc_id, label) of at most ``cap`` documents with a label, the smallest hashes of doc_id first."""
    rows = docs.where(label.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)


def counted(docs: DataFrame, chosen: DataFrame, counts: Callable[[pa.Array], np.ndarray | list]) -> list[tuple[int, object, np.ndarray, np.ndarray]]:
    """(doc_id, label, features, counts) of the chosen documents, by doc_id; one row of a repeated doc_id.

    ``counts`` turns texts into a list of (features, counts). ``chosen`` is
    bounded by the caller, hence the broadcast.
    """

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([f.astype(np.uint32).tobytes() + c.astype(np.uint32).tobytes() for f, c in counts(text)], pa.binary())

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", packed.asNondeterministic()("text").alias("counts"))
    found = {}
    for r in rows.collect():
        both = np.frombuffer(r.counts, np.uint32)
        one = (r.doc_id, r.label, both[: len(both) // 2], both[len(both) // 2 :])
        if r.doc_id not in found or r.counts < found[r.doc_id][1]:
            found[r.doc_id] = one, r.counts
    return [found[k][0] for k in sorted(found)]


def dense_blocks(column: pa.Array, buckets: Callable[[np.ndarray, np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray]], width: int, lap: int = 0):
    """(rows, counts) for groups of documents: a long document's parts are added up before they are yielded.

    ``buckets`` gets bytes, starts and owners of a block, and a dict that it may use to remember the block before.
    """
    kept_row, kept, memory = -1, None, {}
    for data, starts, owners in _text.blocks(column, _text.BLOCK // 4, lap=lap, most=ROWS):
        part, bucket = buckets(data, starts, owners, memory)
        table = np.bincount(part * width + bucket, minlength=len(owners) * width).reshape(len(owners), width).astype(np.float64)
        if kept is not None and owners[0] == kept_row:
            table[0] += kept
        elif kept is not None:
            yield np.array([kept_row]), kept[None]
        kept_row, kept = int(owners[-1]), table[-1]
        if len(owners) > 1:
            inner = owners[:-1]
            if len(np.unique(inner)) == len(inner):
                yield inner, table[:-1]
            else:  # parts of one document inside a block
                rows, at = np.unique(inner, return_index=True)
                yield rows, np.add.reduceat(table[:-1], at, axis=0)
    if kept is not None:
        yield np.array([kept_row]), kept[None]


def training_docs(docs: DataFrame, labels: DataFrame, column: str, cap: int) -> DataFrame:
    _shared.require(docs, "doc_id", "text")
    _shared.require(labels, "doc_id", column)
    return bounded(labels.select("doc_id", column), F.col(column), cap)
