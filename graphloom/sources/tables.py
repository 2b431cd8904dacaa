"""The knowledge graph, chunks, messages and jobs as views over Parquet tables.

Every view reads only the columns it needs; filters on ids and types reach the
scans. Ids are ``kind:key``; a relation's id is ``TYPE:source:target``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import text, udfs

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Words by which people also ask for a relation.
ALIASES = {"BUYS": "PLACED", "ORDERED": "PLACED", "HAS_ITEM": "CONTAINS", "DELIVERS": "SUPPLIES", "IN_NATION": "LOCATED_IN", "BELONGS_TO": "PART_OF"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, primary_type) of every entity."""

    def of(name: str, kind: str, key: str, label: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(kind, key).alias("id"), label.alias("name"), F.lit(kind.upper()).alias("primary_type"))

    return _union([
        of("region", "region", "r_regionkey", F.col("r_name")),
        of("nation", "nation", "n_nationkey", F.col("n_name")),
        of("customer", "customer", "c_custkey", F.col("c_name")),
        of("supplier", "supplier", "s_suppkey", F.col("s_name")),
        of("part", "part", "p_partkey", F.concat_ws(" ", "p_name", "p_brand")),
        of("orders", "orders", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
    ])


def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, alias_name): parts go by their bare name, customers and suppliers by their number."""
    parts = table(spark, sf_dir, "part").select(_id("part", "p_partkey").alias("entity_id"), F.col("p_name").alias("alias_name"))
    customers = table(spark, sf_dir, "customer").select(_id("customer", "c_custkey").alias("entity_id"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("alias_name"))
    suppliers = table(spark, sf_dir, "supplier").select(_id("supplier", "s_suppkey").alias("entity_id"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("alias_name"))
    return _union([parts, customers, suppliers])


def slices(rows: DataFrame, mb: int = 4) -> int:
    """Partitions for ``rows``: one for each few MB of the files they come from, so that a task stays as small as it is while tables grow."""
    spark = rows.sparkSession
    path, conf, files = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), rows.inputFiles()
    if not files:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 + sum(at.getFileSystem(conf).getFileStatus(at).getLen() for at in map(path, files)) // (mb << 20)


def _named(spark: SparkSession, sf_dir: str, rows: DataFrame, end: str, kind: str) -> DataFrame:
    """``rows`` whose ``end`` is a key of ``kind``, with ``end``_name: an equi-join of numbers."""
    name, key, label = _KINDS[kind]
    names = table(spark, sf_dir, name)
    if label is None:  # the key tells the name
        return rows.join(names.select(F.col(key).alias(end)), end).withColumn(f"{end}_name", F.concat(F.lit("Order "), F.col(end).cast("string")))
    return rows.join(names.select(F.col(key).alias(end), label().alias(f"{end}_name")), end)


_KINDS = {
    "region": ("region", "r_regionkey", lambda: F.col("r_name")),
    "nation": ("nation", "n_nationkey", lambda: F.col("n_name")),
    "customer": ("customer", "c_custkey", lambda: F.col("c_name")),
    "supplier": ("supplier", "s_suppkey", lambda: F.col("s_name")),
    "part": ("part", "p_partkey", lambda: F.concat_ws(" ", "p_name", "p_brand")),
    "orders": ("orders", "o_orderkey", None),
}


def _relations(spark: SparkSession, sf_dir: str, named: bool) -> DataFrame:
    """Counts and joins work on keys; ids, which are several times as wide, are made at the end."""
    none = F.array().cast("array<string>")
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d"), F.split(F.lower("p_name"), " ").alias("keywords"))
    n = slices(lines)

    def of(kind: str, source: str, target: str, rows: DataFrame) -> DataFrame:
        if named:
            rows = _named(spark, sf_dir, rows, "s", source)
        if "keywords" not in rows.columns:
            rows = rows.join(part, "d")
        if named:
            rows = _named(spark, sf_dir, rows, "d", target)
        more = [F.col("s_name").alias("source_name"), F.col("d_name").alias("target_name")] if named else []
        rows = rows.select(_id(source, "s").alias("src"), _id(target, "d").alias("dst"), F.col("weight").cast("int").alias("weight"), "keywords", *more)
        return rows.select(F.concat_ws(":", F.lit(kind), "src", "dst").alias("rel_id"), "src", "dst", F.lit(kind).alias("rel_type"), "weight", "keywords", *(["source_name", "target_name"] if named else []))

    def plain(name: str, source: str, target: str, keywords: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(source).alias("s"), F.col(target).alias("d"), F.lit(1).alias("weight"), keywords.alias("keywords"))

    def counted(source: str, by: str) -> DataFrame:
        """Rows are spread by the column that the next join is on."""
        rows = lines.select(F.col(source).alias("s"), F.col("l_partkey").alias("d")).repartition(n, by)
        return rows.groupBy("s", "d").agg(F.least(F.count("*"), F.lit(100)).alias("weight"))

    return _union([
        of("PLACED", "customer", "orders", plain("orders", "o_custkey", "o_orderkey", F.array(F.lower("o_orderpriority")))),
        of("CONTAINS", "orders", "part", counted("l_orderkey", "s" if named else "d")),
        of("SUPPLIES", "supplier", "part", counted("l_suppkey", "d")),
        of("LOCATED_IN", "customer", "nation", plain("customer", "c_custkey", "c_nationkey", F.array(F.lower("c_mktsegment")))),
        of("LOCATED_IN", "supplier", "nation", plain("supplier", "s_suppkey", "s_nationkey", none)),
        of("PART_OF", "nation", "region", plain("nation", "n_nationkey", "n_regionkey", none)),
    ])


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_id, src, dst, rel_type, weight, keywords) of every directed relation."""
    return _relations(spark, sf_dir, False)


def named_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with the names of both ends."""
    return _relations(spark, sf_dir, True)


def relation_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "alias_type string, canonical_type string")


def said() -> Column:
    """The canonical sentence of a named relation."""
    return text.rel_embedding_text(F.col("source_name"), F.col("target_name"), F.col("rel_type"), F.concat_ws(" ", "source_name", F.lower("rel_type"), "target_name"), F.col("keywords"))


def describe(rows: DataFrame) -> DataFrame:
    """Named relations with their embedding of the canonical sentence."""
    return rows.withColumn("embedding", udfs.hash_embedding(said()))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_hash, chunk_index, content, document_id, lang, source) of every document."""
    return table(spark, sf_dir, "documents").select(text.sha256_hex(F.col("text")).alias("chunk_hash"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("doc_id").alias("document_id"), "lang", "source")


ENTITIES_SQL = """entities AS (
  SELECT 'region:' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, 'REGION' AS primary_type FROM region
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), n_name, 'NATION' FROM nation
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), c_name, 'CUSTOMER' FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), s_name, 'SUPPLIER' FROM supplier
  UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), p_name || ' ' || p_brand, 'PART' FROM part
  UNION ALL SELECT 'orders:' || CAST(o_orderkey AS VARCHAR), 'Order ' || CAST(o_orderkey AS VARCHAR), 'ORDERS' FROM orders)"""
ALIASES_SQL = """aliases AS (
  SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS alias_name FROM part
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'customer ' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'supplier ' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""
RELATIONS_SQL = """part_words AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS kw FROM part),
relations AS (SELECT rel_type || ':' || src || ':' || dst AS rel_id, * FROM (
  SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS src, 'orders:' || CAST(o_orderkey AS VARCHAR) AS dst, 'PLACED' AS rel_type, 1 AS weight, [lower(o_orderpriority)] AS keywords FROM orders
  UNION ALL SELECT 'orders:' || CAST(l_orderkey AS VARCHAR), 'part:' || CAST(l_partkey AS VARCHAR), 'CONTAINS', CAST(least(n, 100) AS INTEGER), kw FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) JOIN part_words ON l_partkey = p_partkey
  UNION ALL SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR), 'part:' || CAST(l_partkey AS VARCHAR), 'SUPPLIES', CAST(least(n, 100) AS INTEGER), kw FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) JOIN part_words ON l_partkey = p_partkey
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR), 'LOCATED_IN', 1, [lower(c_mktsegment)] FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'nation:' || CAST(s_nationkey AS VARCHAR), 'LOCATED_IN', 1, CAST([] AS VARCHAR[]) FROM supplier
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'region:' || CAST(n_regionkey AS VARCHAR), 'PART_OF', 1, CAST([] AS VARCHAR[]) FROM nation))"""
NAMED_SQL = f"""{ENTITIES_SQL}, {RELATIONS_SQL},
named AS (SELECT r.*, s.name AS source_name, t.name AS target_name FROM relations r JOIN entities s ON s.id = r.src JOIN entities t ON t.id = r.dst)"""
