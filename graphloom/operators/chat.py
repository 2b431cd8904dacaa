"""Chat memory: context of a question, semantic merges, exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text, udfs

from . import aggregates, graph


def exchange(history: DataFrame, chat: str, question: str, response: str) -> DataFrame:
    """The two rows (conv_id, turn, message_index, role, text) that a new exchange adds."""
    spark = history.sparkSession
    last = history.where(F.col("conv_id") == chat).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("t"), F.coalesce(F.max("message_index"), F.lit(-1)).alias("m"))
    said = spark.createDataFrame([(chat, 1, "user", question), (chat, 2, "assistant", response)], "conv_id string, n int, role string, text string")
    return said.crossJoin(last).select("conv_id", (F.col("t") + 1).alias("turn"), (F.col("m") + F.col("n")).alias("message_index"), "role", "text")


def memory_hits(messages: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """(conv_id, turn, score, rank) of the k messages of the same chat nearest to its question (conv_id, question)."""
    rows = messages.withColumn("v", udfs.hash_embedding("text")).join(questions.withColumn("q", udfs.hash_embedding("question")), "conv_id")
    scored = rows.select("conv_id", "turn", F.round(udfs.cosine_expression(F.col("v"), F.col("q")), 6).alias("score"))
    return aggregates.top_per(scored, ["conv_id"], [F.desc("score"), F.col("turn")], k)


def context_turns(messages: DataFrame, questions: DataFrame, least: float = 0.55, fallback: int = 2, chronology: int = 4) -> DataFrame:
    """(conv_id, turn, reason): near messages, the last two where none is near enough, and the last four in order."""
    hits = memory_hits(messages, questions)
    weak = questions.select("conv_id").distinct().join(hits.groupBy("conv_id").agg(F.max("score").alias("best")).where(F.col("best") >= least), "conv_id", "left_anti")
    last = aggregates.top_per(messages.join(questions.select("conv_id").distinct(), "conv_id", "left_semi"), ["conv_id"], [F.desc("turn")], max(fallback, chronology), "back")
    parts = hits.select("conv_id", "turn", F.lit("semantic").alias("reason"))
    parts = parts.unionByName(last.where(F.col("back") <= fallback).join(weak, "conv_id", "left_semi").select("conv_id", "turn", F.lit("fallback").alias("reason")))
    return parts.unionByName(last.where(F.col("back") <= chronology).select("conv_id", "turn", F.lit("recent").alias("reason")))


def transcript(messages: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, context): the last n messages as one text."""
    rows = aggregates.top_per(messages, ["conv_id"], [F.desc("turn")], n, "back")
    lines = rows.select("conv_id", F.struct("turn", text.format_message(F.col("role"), F.col("text"), F.col("turn")).alias("line")).alias("m"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["line"]), "\n\n").alias("context"))


def union_sorted(old: Column, new: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, description, source_ids, roles): ids and roles united; a new description at least as long wins."""
    n = new.select("node_id", F.col("description").alias("_d"), F.col("source_ids").alias("_s"), F.col("roles").alias("_r"))
    both = old.join(n, "node_id", "full_outer")
    better = F.col("_d").isNotNull() & (F.length("_d") >= F.coalesce(F.length("description"), F.lit(0)))
    return both.select("node_id", F.when(better, F.col("_d")).otherwise(F.col("description")).alias("description"), union_sorted(F.col("source_ids"), F.col("_s")).alias("source_ids"), union_sorted(F.col("roles"), F.col("_r")).alias("roles"))


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, weight, keywords, source_ids): the greater weight, keywords and ids united."""
    n = new.select("src", "dst", F.col("weight").alias("_w"), F.col("keywords").alias("_k"), F.col("source_ids").alias("_s"))
    both = old.join(n, ["src", "dst"], "full_outer")
    return both.select("src", "dst", F.greatest("weight", "_w").alias("weight"), union_sorted(F.col("keywords"), F.col("_k")).alias("keywords"), union_sorted(F.col("source_ids"), F.col("_s")).alias("source_ids"))


def region(nodes: DataFrame, edges: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that come from some messages (message_id), with edge ends and one step around."""
    ids = messages.select("message_id").distinct()
    of = lambda rows, key: rows.select(key, F.explode("source_ids").alias("message_id")).join(ids, "message_id", "left_semi").select(key).distinct()
    seen = of(nodes, "node_id").unionByName(edges.join(of(edges, "rel_id"), "rel_id", "left_semi").select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct()
    around = graph.touching(edges, seen.select(F.col("node_id").alias("node")))
    every = seen.unionByName(around.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct()
    return nodes.join(every, "node_id", "left_semi"), around


def meta_levels(collections: DataFrame, root: str, level: int = 0) -> DataFrame:
    """(name, level) of the meta collections above a level, a leveled name before an old one."""
    rows = collections.select("name", text.meta_root(F.col("name")).alias("root"), text.meta_level(F.col("name")).alias("level"))
    rows = rows.where((F.col("root") == root) & (F.col("level") > level))
    pick = F.row_number().over(Window.partitionBy("level").orderBy(F.col("name").rlike(text.LEVELED).desc(), "name"))
    return rows.withColumn("_n", pick).where("_n = 1").select("name", "level").orderBy("level")
