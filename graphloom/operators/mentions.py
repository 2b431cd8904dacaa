"""Entities that a question names: an index of keys, probed by word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions import text, udfs

LEAST_NAME = 3


def runs(questions: DataFrame) -> DataFrame:
    """(question_id, key): the word runs of (question_id, question), each once."""
    folded = questions.select("question_id", text.mention_key(udfs.casefold("question")).alias("whole"))
    return folded.select("question_id", F.explode(F.array_distinct(text.ngrams(F.col("whole")))).alias("key"))


def index(entities: DataFrame, aliases: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(key, entity_id, name, score): a key of a canonical name (1.0) beats aliases (0.98).

    Of equal canonical keys the greatest id counts, of equal aliases the least.
    ``only``: the keys that are asked for; the rest are dropped as they are read.
    """
    asked = F.lit(True) if only is None else F.col("key").isin(only)
    named = entities.select(F.col("id").alias("entity_id"), "name").withColumn("key", text.mention_key(udfs.casefold("name")))
    named = named.where((F.length("name") >= LEAST_NAME) & asked)
    canonical = named.groupBy("key").agg(F.max(F.struct("entity_id", "name")).alias("m")).select("key", "m.*", F.lit(1.0).alias("score"))
    other = aliases.where(F.length("alias_name") >= LEAST_NAME).withColumn("key", text.mention_key(udfs.casefold("alias_name"))).where(asked)
    other = other.join(canonical.select("key"), "key", "left_anti").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    other = other.groupBy("key").agg(F.min(F.struct("entity_id", "name")).alias("m")).select("key", "m.*", F.lit(0.98).alias("score"))
    return canonical.unionByName(other).where(F.col("key") != "")


def find(questions: DataFrame, keys: DataFrame, limit: int = 20) -> DataFrame:
    """(question_id, entity_id, name, score, rank) of (question_id, question): best score of an entity, longer names first, then ids."""
    hits = runs(questions).join(keys, "key").groupBy("question_id", "entity_id", "name").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc(F.length("name")), "entity_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)
