"""Relation types: dimensions, aliases, election with its rewrites, resolution by likeness, clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text, udfs
from graphloom.sources import store

from . import aggregates, analytics

DEFAULT = "RELATES_TO"
RESOLVED = "collection_id string, seq long, rel_type string, canonical_type string, how string"


def alias_map(aliases: DataFrame) -> DataFrame:
    """(alias_type, canonical_type), both normalised, rows with a blank side dropped, one row of each alias."""
    rows = aliases.where((F.trim("alias_type") != "") & (F.trim("canonical_type") != ""))
    rows = rows.select(text.normalize_rel_type(F.col("alias_type")).alias("alias_type"), text.normalize_rel_type(F.col("canonical_type")).alias("canonical_type"))
    return rows.groupBy("alias_type").agg(F.max("canonical_type").alias("canonical_type"))


def active_dimensions(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ord, rel_type): the distinct canonical types in use in order of their name; the default comes first if no relation has it."""
    found = aggregates.canonical_types(relations, aliases).where(F.trim("canonical_type") != "").select(F.col("canonical_type").alias("rel_type")).distinct()
    first = found.sparkSession.createDataFrame([(DEFAULT,)], "rel_type string").join(found, "rel_type", "left_anti").withColumn("own", F.lit(0))
    rows = first.unionByName(found.withColumn("own", F.lit(1)))
    order = aggregates.Window.orderBy("own", "rel_type")  # as few rows as there are types
    return rows.select((F.row_number().over(order) - 1).alias("ord"), "rel_type")


def created(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (collection_id, canonical_type) rows that have to be added so that all wanted ones exist."""
    rows = wanted.select("collection_id", text.normalize_rel_type(F.col("rel_type")).alias("canonical_type")).distinct()
    return rows.join(types.select("collection_id", "canonical_type"), ["collection_id", "canonical_type"], "left_anti")


def observed(aliases: DataFrame, seen: DataFrame) -> DataFrame:
    """Aliases (type_id, alias_type, frequency, canonical_type) after some observations (type_id, alias_type) and the election that follows."""
    counted = aggregates.counted_types(aliases, seen, ["type_id", "alias_type"])
    return counted.join(aggregates.elected(counted), "type_id")


def reelected(types: DataFrame, aliases: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (type_id, canonical_type) and edges after electing the commonest alias of each type: edges of a renamed type are relabelled and united."""
    best = aggregates.elected(aliases).withColumnRenamed("canonical_type", "_best")
    new = types.join(best, "type_id", "left").select("type_id", F.col("canonical_type").alias("_old"), F.coalesce("_best", "canonical_type").alias("canonical_type"))
    moved = edges.join(new.select(F.col("_old").alias("rel_type"), F.col("canonical_type").alias("_new")), "rel_type", "left").withColumn("rel_type", F.coalesce("_new", "rel_type"))
    united = moved.groupBy("src", "dst", "rel_type").agg(F.least(F.sum("weight"), F.lit(100)).cast("int").alias("weight"))
    return new.drop("_old"), united


def backfilled(types: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """Alias rows for types that have none: a type is its own alias with its number of edges as frequency."""
    count = edges.groupBy(F.col("rel_type").alias("canonical_type")).agg(F.count("*").alias("n"))
    rows = types.join(aliases.select("type_id").distinct(), "type_id", "left_anti").join(count, "canonical_type", "left")
    return rows.select("type_id", "canonical_type", F.col("canonical_type").alias("alias_type"), F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).alias("frequency"))


def corrected(rows: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose value differs from the truth's, nulls included, with the value that they get."""
    both = rows.join(truth.select(key, F.col(column).alias("_new")), key)
    return both.where(~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


class TypeFold:
    """Types, aliases and label vectors of one collection, learnt in order."""

    def __init__(self, embed: Callable[[str], np.ndarray], high: float = 0.8):
        self.embed, self.high = embed, high
        self.of: dict[str, int] = {}  # alias -> type
        self.canonical: list[str] = []
        self.frequency: list[dict[str, int]] = []
        self.vectors: dict[str, np.ndarray] = {}

    def _observe(self, kind: int, label: str, times: int) -> str:
        self.of[label] = kind
        known = self.frequency[kind]
        known[label] = known.get(label, 0) + times
        self.canonical[kind] = min(known, key=lambda a: (-known[a], a))
        return self.canonical[kind]

    def resolve(self, label: str) -> tuple[str, str]:
        """(canonical type, how): a known label, the most alike label, or a new type. A label that is first met counts twice."""
        if label in self.of:
            return self._observe(self.of[label], label, 1), "known"
        if label in self.canonical:
            return self._observe(self.canonical.index(label), label, 1), "known"
        vector = self.embed(label)
        best, score = None, self.high
        for other, v in self.vectors.items():
            n = float(np.linalg.norm(vector) * np.linalg.norm(v))
            alike = round(float(vector @ v) / n, 6) if n else -1.0
            if alike >= score and (best is None or alike > score):
                best, score = other, alike
        self.vectors[label] = vector
        if best is not None:
            return self._observe(self.of[best], label, 2), "alike"
        self.canonical.append(label)
        self.frequency.append({})
        return self._observe(len(self.canonical) - 1, label, 2), "new"


def label_vector(label: str) -> np.ndarray:
    """The embedding of a type's words."""
    return udfs.embed(label.replace("_", " "))


def resolved_types(seen: DataFrame, embed: Callable[[str], np.ndarray] = label_vector, high: float = 0.8) -> DataFrame:
    """Canonical type of every observation (collection_id, seq, rel_type), in the order of seq; a collection is one sequence."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = TypeFold(embed, high), []
        for r in frame.sort_values(["seq", "rel_type"], kind="stable").itertuples(index=False):
            out.append((r.collection_id, r.seq, r.rel_type, *state.resolve(r.rel_type)))
        return pd.DataFrame(out, columns=["collection_id", "seq", "rel_type", "canonical_type", "how"])

    rows = seen.select("collection_id", F.col("seq").cast("bigint").alias("seq"), text.normalize_rel_type(F.col("rel_type")).alias("rel_type"))
    return rows.groupBy("collection_id").applyInPandas(fold, RESOLVED)


def clustered(counts: DataFrame, least: float = 0.8) -> DataFrame:
    """(rel_type, representative): types whose labels are alike, in connected components; the commonest stands for all.

    Types are few, and labels can only be alike if they share a word, so the
    pairs come from an equi-join on words.
    """
    kinds = counts.select("rel_type", "n", F.split(F.lower("rel_type"), "_").alias("words"))
    tokens = kinds.select("rel_type", F.explode(F.array_distinct("words")).alias("word"))
    pairs = tokens.select(F.col("rel_type").alias("a"), "word").join(tokens.select(F.col("rel_type").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    vectors = kinds.select("rel_type", udfs.hash_embedding(F.array_join("words", " ")).alias("v"))
    near = pairs.join(vectors.select(F.col("rel_type").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("rel_type").alias("b"), F.col("v").alias("y")), "b")
    near = near.where(F.round(udfs.cosine_expression(F.col("x"), F.col("y")), 6) >= least).select("a", "b")
    of = kinds.select("rel_type", "n").join(analytics.components(near).select(F.col("node").alias("rel_type"), "component"), "rel_type", "left").withColumn("component", F.coalesce("component", "rel_type"))
    best = of.groupBy("component").agg(F.max_by("rel_type", F.struct("n", "rel_type")).alias("representative"))
    return of.join(best, "component").select("rel_type", "representative")


def summarised(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(representative, members, total): the groups of types with their counts added up."""
    rows = counts.join(mapping, "rel_type").groupBy("representative")
    return rows.agg(F.array_sort(F.collect_list("rel_type")).alias("members"), F.sum("n").alias("total"))


def dimension_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(rel_type, score, top): the best likeness of a relation to each type's question (rel_type, query), plus the mean of the best three."""
    asked = queries.select("rel_type", "query")
    near = vectors.select("rel_id", "embedding").crossJoin(F.broadcast(asked))  # one question per type: 50 at most
    scored = near.select("rel_type", "rel_id", F.round(udfs.cosine_expression(F.col("embedding"), F.col("query")), 6).alias("sim"))
    best = aggregates.top_per(scored, ["rel_type"], [F.desc("sim"), F.col("rel_id")], 3)
    return best.groupBy("rel_type").agg(F.round(F.max("sim") + F.avg("sim"), 6).alias("score"), F.max("sim").alias("top"))


def relabelled(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges after several renames (rel_type, canonical_type) at once."""
    rows = edges.join(F.broadcast(renamed), "rel_type", "left").withColumn("rel_type", F.coalesce("canonical_type", "rel_type")).drop("canonical_type")
    return store.relabel(rows, "", "")
