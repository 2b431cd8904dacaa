"""Ingestion of chunks from end to end: sanitise, identify, extract, resolve, store, and the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text, udfs

from . import extract, prepare

#: Source chunks that a name-keyed node keeps.
MOST_SOURCES = 300


def identified(chunks: DataFrame, collection: Column, column: str = "text") -> DataFrame:
    """Chunks (chunk_id, text, path) with clean text, its hash, the document's id (by path, else by chunk) and what the sanitiser found."""
    rows = prepare.sanitized(chunks, column).withColumn("chunk_hash", text.sha256_hex(F.col("clean")))
    path = text.normalize_path(F.col("path"))
    own = F.when(path != "", text.uuid5(text.collection_namespace(collection), path)).otherwise(text.document_id_for_chunk(collection, F.col("chunk_hash")))
    return rows.withColumn("document_id", own).withColumn("path", F.nullif(path, F.lit("")))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, chunk_index, content, token_count, document_id, embedding) for the vector strategy: one row per hash and place."""
    rows = chunks.select("chunk_hash", "chunk_index", F.col("clean").alias("content"), F.size(text.words(F.col("clean"))).alias("token_count"), "document_id").dropDuplicates(["chunk_hash", "chunk_index"])
    return rows.withColumn("embedding", udfs.hash_embedding("content"))


def once(chunks: DataFrame) -> DataFrame:
    """One row of each content: extraction and storage are keyed by the hash."""
    first = F.row_number().over(Window.partitionBy("chunk_hash").orderBy("chunk_id"))
    return chunks.withColumn("_n", first).where("_n = 1").drop("_n")


def triples(chunks: DataFrame, model: Callable[[str, list], str], passes: int = 1) -> DataFrame:
    """Extracted triples of every content, keyed by its hash."""
    return extract.extracted(once(chunks).select(F.col("chunk_hash").alias("chunk_id"), F.col("clean").alias("content")), model, passes)


def graph_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, entity_type, description) and edges (source, target, rel_type, weight, keywords) of the graph strategy.

    Names are resolved by title case, the first to come stays; an end that no
    entity names becomes an entity of its own; weights are tenths, 10 for a
    whole, and add up to 100.
    """
    relations = extract.merged_relations(found)
    entities = extract.merged_entities(found).withColumn("key", udfs.title(F.trim("name")))
    order = F.struct("chunk_id", "ord")
    names = entities.groupBy("key").agg(F.min_by("name", order).alias("name"), F.min_by("entity_type", order).alias("entity_type"), F.max_by("description", F.length("description")).alias("description"))
    ends = relations.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("key", udfs.title(F.trim("name")))
    missing = ends.join(names, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name")).select("key", "name", F.lit("").alias("entity_type"), F.lit("").alias("description"))
    nodes = names.unionByName(missing)
    of = nodes.select("key", F.col("name").alias("canonical"))
    keyed = relations.withColumn("sk", udfs.title(F.trim("source"))).withColumn("tk", udfs.title(F.trim("target")))
    keyed = keyed.join(of.withColumnsRenamed({"key": "sk", "canonical": "s"}), "sk").join(of.withColumnsRenamed({"key": "tk", "canonical": "t"}), "tk")
    edges = extract.resolved_relations(keyed.select(F.col("s").alias("source"), F.col("t").alias("target"), "rel_type", "weight", "keywords"))
    return nodes.drop("key"), edges


def named_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, description, source_ids) and edges (source, target, weight, keywords, source_ids) of the name-keyed strategy.

    Descriptions of chunks are joined by ``; `` in order, a node keeps its
    first 300 sources; edges need both ends among the entities of their chunk.
    """
    entities = extract.merged_entities(found)
    told = F.array_sort(F.collect_list(F.struct("chunk_id", "ord", "description")))
    nodes = entities.groupBy("name").agg(F.max_by("entity_type", F.struct("chunk_id", "ord")).alias("type"), told.alias("_t"))
    nodes = nodes.select("name", "type", F.array_join(F.filter(F.transform("_t", lambda x: x["description"]), lambda d: d != ""), "; ").alias("description"), F.slice(F.array_distinct(F.transform("_t", lambda x: x["chunk_id"])), 1, MOST_SOURCES).alias("source_ids"))
    known = entities.select("chunk_id", "name")
    relations = extract.merged_relations(found)
    inside = relations.join(known.withColumnRenamed("name", "source"), ["chunk_id", "source"], "left_semi").join(known.withColumnRenamed("name", "target"), ["chunk_id", "target"], "left_semi")
    last = F.struct("chunk_id", "ord")
    edges = inside.groupBy("source", "target").agg(F.max_by((F.col("weight") * 10).cast("int"), last).alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"), F.array_sort(F.collect_set("chunk_id")).alias("source_ids"))
    return nodes, edges


def ledger(chunks: DataFrame, strategy: str, found: DataFrame | None = None) -> DataFrame:
    """(chunk_id, chunk_hash, document_id, strategy, entity_count, relationship_count, severity): a row of every chunk; severity null where nothing was found."""
    rows = chunks.select("chunk_id", "chunk_hash", "document_id", F.lit(strategy).alias("strategy"), F.when(F.col("severity") != "none", F.col("severity")).alias("severity"))
    if found is None:
        return rows.withColumns({"entity_count": F.lit(0).cast("bigint"), "relationship_count": F.lit(0).cast("bigint")})
    relations = extract.merged_relations(found).groupBy(F.col("chunk_id").alias("chunk_hash")).agg(F.count("*").alias("relationship_count"))
    entities = extract.merged_entities(found).groupBy(F.col("chunk_id").alias("chunk_hash")).agg(F.count("*").alias("entity_count"))
    return rows.join(entities, "chunk_hash", "left").join(relations, "chunk_hash", "left").na.fill(0, ["entity_count", "relationship_count"])


def described(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Descriptions (rel_id, document_id, description, weight, hashes) after some sightings (rel_id, document_id, seq, description, chunk_hash).

    A relation has one description per document: the first to come; each more
    adds 1 to the weight and its hash. Without a document each sighting is a
    description of its own.
    """
    first = F.min_by("description", "seq")
    hashes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_hash"))), lambda x: x["chunk_hash"]))
    of_document = seen.where(F.col("document_id").isNotNull()).groupBy("rel_id", "document_id").agg(first.alias("_d"), F.count("*").alias("_w"), hashes.alias("_h"))
    both = old.join(of_document, ["rel_id", "document_id"], "full_outer")
    merged = both.select("rel_id", "document_id", F.coalesce("description", "_d").alias("description"), (F.coalesce("weight", F.lit(0)) + F.coalesce("_w", F.lit(0))).cast("bigint").alias("weight"), F.array_union(F.coalesce("hashes", F.array().cast("array<string>")), F.coalesce("_h", F.array().cast("array<string>"))).alias("hashes"))
    alone = seen.where(F.col("document_id").isNull()).select("rel_id", "document_id", "description", F.lit(1).cast("bigint").alias("weight"), F.array("chunk_hash").alias("hashes"))
    return merged.unionByName(alone)
