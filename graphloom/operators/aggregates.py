"""Aggregations, first-seen and top-N idioms, and query states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text
from graphloom.sources import tables

_ROUTES = {
    "hub": "CALLS USES EMITS SENDS SPAWNS",
    "authority": "DEFINES EXTENDS IMPLEMENTS CONTAINS AUTHORED_BY",
    "bridge": "DEPENDS_ON CONNECTS_TO GUARDS AUTHORIZES AUTHENTICATES",
    "central": "IMPORTS REFERENCES RELATES_TO ABOUT",
    "importance": "DOCUMENTS DESCRIBES SUMMARIZES PROVES",
}
ROUTES = {route: tuple(kinds.split()) for route, kinds in _ROUTES.items()}
BASE = {"central": 1.0, "importance": 0.8}


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank; Spark prunes groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def max_normalised(c: str, over: list[str]) -> Column:
    """Divided by the maximum; all zero where it isn't positive."""
    most = F.max(c).over(Window.partitionBy(*over))
    return F.when(most > 0, F.col(c) / most).otherwise(0.0)


def primary_family(counts: DataFrame, key: str) -> DataFrame:
    """(key, family) with the highest count, 'generic_other' only for want of others; ties by the order of families."""
    order = F.array_position(F.array(*[F.lit(f) for f in text.FAMILY_ORDER]), F.col("family"))
    best = F.max_by("family", F.struct((F.col("family") != "generic_other").alias("own"), F.col("n").alias("n"), (-order).alias("o")))
    return counts.groupBy(key).agg(best.alias("family"))


def canonical_types(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with ``canonical_type``: the alias table's, else the type itself."""
    known = aliases.select(text.normalize_rel_type(F.col("alias_type")).alias("_kind"), text.normalize_rel_type(F.col("canonical_type")).alias("_canonical"))
    rows = edges.withColumn("_kind", text.normalize_rel_type(F.col("rel_type")))
    return rows.join(known, "_kind", "left").withColumn("canonical_type", F.coalesce("_canonical", "_kind")).drop("_kind", "_canonical")


def route_profile(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """(query_id, one column per route, primary_route) from (query_id, canonical_type, combined), in tasks of a fixed size."""
    total = {r: F.coalesce(F.sum(F.when(F.col("canonical_type").isin(*types), F.col("combined"))), F.lit(0.0)) for r, types in ROUTES.items()}
    total["importance"] = total["importance"] * 0.5
    rows = scored.repartition(tables.slices(scored), key).groupBy(key).agg(*[F.round(total[r] + F.lit(BASE.get(r, 0.0)), 6).alias(r) for r in ROUTES])
    first = reduce(lambda c, r: c.when(F.col(r) == F.greatest(*ROUTES), r), list(ROUTES)[1:], F.when(F.col("hub") == F.greatest(*ROUTES), "hub"))
    return rows.withColumn("primary_route", first)


def merge_entity_states(states: list[DataFrame]) -> DataFrame:
    """(query_id, entity_id, relevance): union with the highest relevance."""
    return reduce(DataFrame.unionByName, states).groupBy("query_id", "entity_id").agg(F.max("relevance").alias("relevance"))


def merge_relation_states(states: list[DataFrame]) -> DataFrame:
    """(query_id, rel_id, combined, ord): the last state's score wins, order by score and first appearance."""
    marked = [s.select("query_id", "rel_id", "combined", F.struct(F.lit(i).alias("state"), F.col("ord").alias("ord")).alias("at")) for i, s in enumerate(states)]
    rows = reduce(DataFrame.unionByName, marked).groupBy("query_id", "rel_id").agg(F.max_by("combined", "at").alias("combined"), F.min("at").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined"), "first")
    return rows.select("query_id", "rel_id", "combined", F.row_number().over(order).alias("ord"))


def counted_types(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Counters after adding an observation for each row of ``seen``."""
    fresh = seen.groupBy(*keys).agg(F.count("*").alias("frequency"))
    return old.select(*keys, "frequency").unionByName(fresh).groupBy(*keys).agg(F.sum("frequency").alias("frequency"))


def elected(aliases: DataFrame) -> DataFrame:
    """(type_id, canonical_type): the most frequent alias of each type, the first in alphabetical order of equals."""
    best = F.min_by("alias_type", F.struct((-F.col("frequency")).alias("f"), F.col("alias_type").alias("a")))
    return aliases.groupBy("type_id").agg(best.alias("canonical_type"))


def budgeted(rows: DataFrame, keys: list[str], order: list[Column], content: str, budget: int) -> DataFrame:
    """Rows of each group that fit a word budget before the first overflow, and the cut text of that one if over 10 words are left.

    Adds ``tokens``, ``shown`` and ``whole``. The sum of words up to a row tells it all.
    """
    tokens = F.greatest(F.lit(1), F.size(text.words(F.col(content))))
    before = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("tokens", tokens).withColumn("_upto", F.sum("tokens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_left", F.lit(budget) - (F.col("_upto") - F.col("tokens")))
    whole = F.col("_upto") <= budget
    first_over = ~whole & (F.col("_left") >= 0)
    cut = F.concat(F.substring(F.col(content), F.lit(1), F.col("_left").cast("int") * 4), F.lit("..."))
    # sums only grow, so the first overflow is the one row beyond the budget whose predecessors all fit
    kept = marked.where(whole | (first_over & (F.col("_left") > 10)))
    return kept.withColumn("whole", whole).withColumn("shown", F.when(whole, F.col(content)).otherwise(cut)).drop("_upto", "_left")


def job_progress(events: DataFrame, total: DataFrame) -> DataFrame:
    """(job_id, done, percent, status) from finished chunks and the number of chunks of each job."""
    done = events.groupBy("job_id").agg(F.count_if(F.col("state") == "completed").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    rows = total.join(done, "job_id", "left").na.fill(0, ["done", "failed"])
    percent = F.floor(100 * (F.col("done") + F.col("failed")) / F.greatest("n_chunks", F.lit(1))).cast("int")
    status = F.when(F.col("done") + F.col("failed") < F.col("n_chunks"), "processing").when(F.col("failed") > 0, "failed").otherwise("completed")
    return rows.select("job_id", "done", F.least(percent, F.lit(100)).alias("percent"), status.alias("status"))


def recent(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each chat, in their order."""
    return top_per(messages, ["conv_id"], [F.desc("turn")], n, "back").orderBy("conv_id", "turn")
