"""Access to a property graph kept as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import knn


def symmetric(edges: DataFrame, *more: str) -> DataFrame:
    """(node, neighbour, rel_id, rel_type, direction, ...): every edge from both its ends."""
    keep = ["rel_id", "rel_type", *more]
    end = lambda node, neighbour, direction: F.struct(F.col(node).alias("node"), F.col(neighbour).alias("neighbour"), F.lit(direction).alias("direction"))
    # one pass over the edges: a union would compute them twice
    both = edges.select(F.explode(F.array(end("src", "dst", "out"), end("dst", "src", "in"))).alias("_end"), *keep)
    return both.select("_end.node", "_end.neighbour", *keep, "_end.direction")


def neighbours(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, neighbour, rel_type) of all nodes in ``nodes``; the type filter reaches the scan."""
    kept = edges.where(knn.labels_filter(F.col("rel_type"), types))
    return symmetric(kept).join(nodes.select("node").distinct(), "node", "left_semi").select("node", "neighbour", "rel_type", "rel_id")


def get_edge(edges: DataFrame, pairs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The edge of least id of each directed (src, dst)."""
    kept = edges.where(knn.labels_filter(F.col("rel_type"), types)).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy("rel_id"))).where("_n = 1").drop("_n")


def name_contains(entities: DataFrame, aliases: DataFrame, word: Column | str, limit: int = 10) -> DataFrame:
    """(id, name) of entities whose name or an alias holds a word, by id."""
    word = F.lower(F.lit(word) if isinstance(word, str) else word)
    by_alias = aliases.where(F.lower("alias_name").contains(word)).select(F.col("entity_id").alias("id"))
    hits = entities.where(F.lower("name").contains(word)).select("id").unionByName(by_alias).distinct()
    return entities.join(hits, "id", "left_semi").select("id", "name").orderBy("id").limit(limit)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in ``nodes``: two semi joins, as a disjunction would be a nested loop."""
    ids = nodes.select(F.col("node").alias("_n")).distinct()
    left = edges.join(ids, edges["src"] == ids["_n"], "left_semi")
    return left.unionByName(edges.join(ids, edges["dst"] == ids["_n"], "left_semi").join(ids, edges["src"] == ids["_n"], "left_anti"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select(F.col("node").alias("_n")).distinct()
    return edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, edges["dst"] == ids["_n"], "left_semi")


def ego(edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(node, hops) within ``depth`` undirected steps; each step is one join of the frontier."""
    both = symmetric(edges)
    seen = both.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hops") == hop - 1).select("node")
        fresh = both.join(frontier, "node").select(F.col("neighbour").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(fresh.withColumn("hops", F.lit(hop)))
    return seen


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) in one aggregation."""
    return symmetric(edges).groupBy("node").agg(F.count_if(F.col("direction") == "out").alias("out_degree"), F.count_if(F.col("direction") == "in").alias("in_degree"))


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(symmetric(edges).select(F.col("node").alias("id")).distinct(), "id", "left_anti")
