"""Incremental entity resolution: a fold in ingest order, one task per collection.

Each step depends on the centroids that the steps before left, so a collection
is one sequence; collections run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import udfs

RESOLVED = "collection_id string, seq long, name string, entity_id string, canonical_name string, how string"
APART = {frozenset(p) for p in (("person", "place"), ("person", "object"), ("place", "concept"))}


def compatible(a: str, b: str) -> bool:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return not a or not b or a == b or frozenset((a, b)) not in APART


class Fold:
    """Names, aliases and centroids of one collection."""

    def __init__(self, high: float = 0.8, low: float = 0.65, duplicate: float = 0.9, exact: bool = False):
        self.high, self.low, self.duplicate, self.exact = high, low, duplicate, exact
        self.ids: dict[str, int] = {}
        self.alias: dict[str, int] = {}
        self.names: list[str] = []
        self.kinds: list[str] = []
        self.counts: list[int] = []
        self.notes: list[list[np.ndarray]] = []
        self.centroid = np.zeros((0, udfs.DIMENSIONS))

    def _similar(self, vector: np.ndarray, name: str, kind: str) -> int | None:
        score = self.centroid @ vector
        for k in np.lexsort((np.arange(len(score)), -score))[:5].tolist():
            if score[k] < self.low:
                break
            if compatible(kind, self.kinds[k]) and (score[k] >= self.high or udfs.same_name(name, self.names[k])):
                return k
        return next((k for k, other in enumerate(self.names) if compatible(kind, self.kinds[k]) and udfs.same_name(name, other)), None)

    def _learn(self, k: int, vector: np.ndarray) -> None:
        """A description that is alike to one already there adds nothing."""
        if any(float(v @ vector) >= self.duplicate for v in self.notes[k]):
            return
        self.notes[k].append(vector)
        n = self.counts[k]
        mean = (self.centroid[k] * n + vector) / (n + 1)
        self.centroid[k], self.counts[k] = mean / (np.linalg.norm(mean) or 1.0), n + 1

    def resolve(self, name: str, kind: str, description: str) -> tuple[int, str]:
        name = " ".join((name or "").split())[:256]
        vector = udfs.embed(f"{name} {description or ''}")
        how = "alias"
        k = None if self.exact else self.alias.get(name)
        if k is None:
            k, how = self.ids.get(name), "canonical"
        if k is None and not self.exact:
            k, how = self._similar(vector, name, kind), "similar"
            if k is not None:
                self.alias[name] = k
        if k is None:
            k, how = len(self.names), "new"
            self.ids[name] = k
            self.names.append(name)
            self.kinds.append(kind or "")
            self.counts.append(1)
            self.notes.append([vector])
            self.centroid = np.vstack([self.centroid, vector])
        else:
            self._learn(k, vector)
        return k, how


def resolved(mentions: DataFrame, exact: bool = False) -> DataFrame:
    """Entity of every mention (collection_id, seq, name, entity_type, description), in the order of seq."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = Fold(exact=exact), []
        for r in frame.sort_values(["seq", "name"], kind="stable").itertuples(index=False):
            k, how = state.resolve(r.name, r.entity_type, r.description)
            out.append((r.collection_id, r.seq, r.name, f"{r.collection_id}:{k}", state.names[k], how))
        return pd.DataFrame(out, columns=["collection_id", "seq", "name", "entity_id", "canonical_name", "how"])

    return mentions.select("collection_id", F.col("seq").cast("bigint").alias("seq"), "name", "entity_type", "description").groupBy("collection_id").applyInPandas(fold, RESOLVED)


def first_writers(rows: DataFrame) -> DataFrame:
    """(key, entity_id): names by title case, the first to come stays."""
    titled = rows.select(udfs.title("name").alias("key"), "entity_id", "seq")
    return titled.groupBy("key").agg(F.min_by("entity_id", F.struct("seq", "entity_id")).alias("entity_id"))
