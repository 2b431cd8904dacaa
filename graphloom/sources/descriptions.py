"""Descriptions of entities and relations as views over Parquet tables, and their embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text, udfs

from . import tables

DOCUMENTS = 100


def entity_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, description, weight, document_id): what customers order, what parts are, where suppliers are."""
    ordered = tables.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("int").alias("weight"))
    ordered = ordered.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity_id"), F.concat(F.lit("orders with priority "), F.lower("o_orderpriority")).alias("description"), "weight", (F.col("o_custkey") % DOCUMENTS).alias("document_id"))
    parts = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat_ws(" ", F.lower("p_type"), F.lit("of size"), F.col("p_size").cast("string")).alias("description"), F.lit(1).alias("weight"), (F.col("p_partkey") % DOCUMENTS).alias("document_id"))
    suppliers = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")).alias("description"), F.lit(1).alias("weight"), (F.col("s_suppkey") % DOCUMENTS).alias("document_id"))
    return ordered.unionByName(parts).unionByName(suppliers)


def relation_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_id, description, weight, document_id): one of each order, one of each line of an order."""
    order, customer, part = (F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")) for kind, key in (("orders", "o_orderkey"), ("customer", "o_custkey"), ("part", "l_partkey")))
    placed = tables.table(spark, sf_dir, "orders").select(F.concat_ws(":", F.lit("PLACED"), customer, order).alias("rel_id"), F.concat_ws(" ", F.lower("o_orderpriority"), "o_orderstatus").alias("description"), F.lit(1).alias("weight"), (F.col("o_orderkey") % DOCUMENTS).alias("document_id"))
    line = F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string"))
    lines = tables.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.lit("CONTAINS"), line, part).alias("rel_id"), F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("description"), F.col("l_linenumber").alias("weight"), (F.col("l_orderkey") % DOCUMENTS).alias("document_id"))
    return placed.unionByName(lines)


def entity_vectors(named: DataFrame) -> DataFrame:
    """Entities (id, name, ...) with the embedding of their name."""
    return named.withColumn("embedding", udfs.hash_embedding("name"))


def relation_vectors(named: DataFrame, described: DataFrame) -> DataFrame:
    """(rel_id, source_name, target_name, rel_type, description, document_id, embedding) of every description of a named relation."""
    rows = named.join(described.select("rel_id", "description", "document_id"), "rel_id")
    said = text.rel_embedding_text(F.col("source_name"), F.col("target_name"), F.col("rel_type"), F.col("description"), F.col("keywords"))
    return rows.select("rel_id", "src", "dst", "source_name", "target_name", "rel_type", "description", "document_id", said.alias("said")).withColumn("embedding", udfs.hash_embedding("said"))


ENTITY_SQL = f"""edesc AS (
  SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS entity_id, 'orders with priority ' || lower(o_orderpriority) AS description, CAST(count(*) AS INTEGER) AS weight, o_custkey % {DOCUMENTS} AS document_id FROM orders GROUP BY o_custkey, o_orderpriority
  UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), lower(p_type) || ' of size ' || CAST(p_size AS VARCHAR), 1, p_partkey % {DOCUMENTS} FROM part
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'supplier of nation ' || CAST(s_nationkey AS VARCHAR), 1, s_suppkey % {DOCUMENTS} FROM supplier)"""
RELATION_SQL = f"""rdesc AS (
  SELECT 'PLACED:customer:' || CAST(o_custkey AS VARCHAR) || ':orders:' || CAST(o_orderkey AS VARCHAR) AS rel_id, lower(o_orderpriority) || ' ' || o_orderstatus AS description, 1 AS weight, o_orderkey % {DOCUMENTS} AS document_id FROM orders
  UNION ALL SELECT 'CONTAINS:orders:' || CAST(l_orderkey AS VARCHAR) || ':part:' || CAST(l_partkey AS VARCHAR), 'line ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag, l_linenumber, l_orderkey % {DOCUMENTS} FROM lineitem)"""
