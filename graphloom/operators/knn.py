"""Exact nearest neighbours by cosine, with filters pushed below the scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import udfs


def metadata_filter(metadata: Column, wanted: dict[str, str] | None) -> Column:
    """All keys of a JSON object equal the wanted values; no wishes, no filter."""
    ok = F.lit(True)
    for key, value in (wanted or {}).items():
        ok = ok & (F.get_json_object(metadata, f"$.{key}") == value)
    return ok


def in_list(c: Column, values: Sequence | None) -> Column:
    """An empty list is no filter."""
    return c.isin(list(values)) if values else F.lit(True)


def labels_filter(rel_type: Column, types: Sequence[str | None] | None) -> Column:
    """None or an empty list: any type. A list of blanks only: no type."""
    if not types:
        return F.lit(True)
    wanted = [t for t in types if t]
    return rel_type.isin(wanted) if wanted else F.lit(False)


def validated(embedding: Column) -> Column:
    """The embedding, an error if it is empty or not finite."""
    good = (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, embedding).otherwise(F.raise_error(F.lit("an embedding must be finite and not empty")))


def top(rows: DataFrame, query: Sequence[float], k: int, key: str, where: Column | None = None, column: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector with ``score``; ties by key, vectors without a score last.

    The filter comes first, so it reaches the scan, and only k rows leave each task.
    """
    kept = rows if where is None else rows.where(where)
    return kept.withColumn("score", udfs.similarity(F.col(column), query)).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def top_texts(rows: DataFrame, query: Sequence[float], k: int, key: str, column: str) -> DataFrame:
    """The k rows whose text is nearest to one vector; vectors of texts aren't kept."""
    return rows.withColumn("score", udfs.text_similarity(F.col(column), query)).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def batch_top(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", block: int = 512) -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of each of a bounded set of query vectors.

    Queries are sent to the tasks in blocks of ``block``, each a pass over the
    rows; a task keeps k rows per query, so only partial results are shuffled.
    """
    spark = rows.sparkSession
    found = None
    asked = [(r[0], r[1]) for r in queries.select(query_key, column).where(F.col(column).isNotNull()).toLocalIterator()]
    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *queries.schema.fields]}
    schema = f"{query_key} {kind[query_key]}, {key} {kind[key]}, score double"
    for a in range(0, len(asked), block):
        ids, q = [i for i, _ in asked[a : a + block]], np.array([v for _, v in asked[a : a + block]], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, q))

        def nearest(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = [(np.zeros(0), np.zeros(0, object))] * len(ids)
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                name = np.array(batch.column(0).to_pylist(), object)
                score = np.round(q @ x.T, 6)
                for i in range(len(ids)):
                    s, n = np.r_[best[i][0], score[i]], np.r_[best[i][1], name]
                    order = np.lexsort((n, -s))[:k] if len(n) <= 4 * k else np.flatnonzero(s >= np.partition(s, -k)[-k])
                    order = order[np.lexsort((n[order], -s[order]))][:k]
                    best[i] = s[order], n[order]
            for i, (s, n) in enumerate(best):
                if len(n):
                    yield pa.RecordBatch.from_pydict({query_key: [ids[i]] * len(n), key: n.tolist(), "score": s})

        width = q.shape[1]
        part = rows.select(key, F.col(column).cast("array<double>").alias(column)).where(F.size(column) == width).mapInArrow(nearest, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per(hits: DataFrame, key: str, at_least: float = 0.3) -> DataFrame:
    """(key, score): the best hit of each key that reaches a similarity."""
    return hits.groupBy(key).agg(F.max("score").alias("score")).where(F.col("score") >= at_least)
