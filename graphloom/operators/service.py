"""Collections, jobs and chats as tables: each function takes a table and gives the rows that a call adds or the table after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import text
from graphloom.sources import store

STRATEGIES = ("vector", "light_rag", "custom_graph_rag")
ENDED = ("completed", "failed", "cancelled")
NODE_PROPERTIES = tuple("name canonical_name primary_type description aliases source_ids source_roles document_id document_path collection_id".split())
EDGE_PROPERTIES = tuple("rel_id weight keywords description source_ids document_id document_path collection_id".split())


def whitelisted(rows: DataFrame, keys: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """Keys and allowed properties only."""
    return rows.select(*keys, *[c for c in rows.columns if c in allowed and c not in keys])


def upsert_node(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes (id, ...) after a merge of allowed properties; nulls leave what is there."""
    return store.upsert(nodes, _aligned(whitelisted(rows, ["id"], NODE_PROPERTIES), nodes), ["id"])


def upsert_edge(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (src, dst, rel_type, ...) after a merge of allowed properties; a relation without a type is RELATES_TO."""
    keys = ["src", "dst", "rel_type"]
    typed = rows.withColumn("rel_type", text.normalize_rel_type(F.col("rel_type")))
    return store.upsert(edges, _aligned(whitelisted(typed, keys, EDGE_PROPERTIES), edges), keys)


def upsert_named_node(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes keyed by (collection_id, name); without a type they are UNKNOWN."""
    merged = store.upsert(nodes, _aligned(rows, nodes), ["collection_id", "name"])
    return merged.withColumn("type", F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("UNKNOWN")))


def _aligned(rows: DataFrame, table: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return rows.select(*[c for c in rows.columns if c in kinds], *[F.lit(None).cast(kinds[c]).alias(c) for c in table.columns if c not in rows.columns])


def submitted(requests: DataFrame, now: str) -> DataFrame:
    """Job rows (job_id, collection_id, kind, status, payload, created_at) for requests (job_id, collection_id, kind, payload)."""
    return requests.select("job_id", "collection_id", "kind", F.lit("pending").alias("status"), F.col("payload").cast("string").alias("payload"), F.to_timestamp(F.lit(now)).alias("created_at"))


def status_changed(jobs: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Jobs after status changes (job_id, new_status, new_error): the first 'running' stamps the start, an end the completion."""
    at = F.to_timestamp(F.lit(now)).cast("timestamp_ntz")
    rows = jobs.join(changes, "job_id", "left")
    moved = F.col("new_status").isNotNull()
    return rows.select(
        "job_id",
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce(F.nullif(F.col("new_error"), F.lit("")), "error").alias("error"),
        F.when(moved & (F.col("new_status") == "running"), F.coalesce("started_at", at)).otherwise(F.col("started_at")).alias("started_at"),
        F.when(moved & F.col("new_status").isin(*ENDED), at).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def marked_cancelled(marked: DataFrame, jobs: DataFrame) -> DataFrame:
    """The job ids that a cancellation adds to the table of cancelled jobs."""
    return jobs.where(F.col("job_id").isNotNull()).select("job_id").distinct().join(marked.select("job_id"), "job_id", "left_anti")


def finalised(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Jobs after their cancellation: those that had ended stay as they are."""
    hit = cancelled.select("job_id").distinct().withColumn("_hit", F.lit(True))
    rows = jobs.join(hit, "job_id", "left")
    stops = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    return rows.withColumn("status", F.when(stops, "cancelled").otherwise(F.col("status"))).drop("_hit")


def results(jobs: DataFrame) -> DataFrame:
    """(job_id, result) of completed jobs: the result inside the payload."""
    return jobs.where(F.col("status") == "completed").select("job_id", F.get_json_object("payload", "$.result").alias("result"))


def events_of(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """The events that may be appended: those of jobs that exist."""
    return events.join(jobs.select("job_id").distinct(), "job_id", "left_semi")


def newest(rows: DataFrame, at: str, key: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The last rows by time; only ``limit`` rows leave each task."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(at), key).limit(limit)


def chat_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, n_messages, n_user, last_turn) of all sessions, empty ones too."""
    said = messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"))
    return sessions.join(said, "chat_id", "left").na.fill(0, ["n_messages", "n_user"])


def next_places(messages: DataFrame) -> DataFrame:
    """(chat_id, next_turn, next_message): where the next exchange goes."""
    return messages.groupBy("chat_id").agg((F.max("turn") + 1).alias("next_turn"), (F.max("message_index") + 1).alias("next_message"))


def checked_collections(rows: DataFrame) -> DataFrame:
    """New collections with their defaults; an unknown strategy or an empty name is an error."""
    good = F.trim("name") != ""
    strategy = F.when(F.col("strategy").isin(*STRATEGIES), F.col("strategy")).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce("strategy", F.lit("null")))).cast("string"))
    named = F.when(good, F.trim("name")).otherwise(F.raise_error(F.lit("a collection needs a name")).cast("string"))
    mode = F.when(F.col("strategy") == "custom_graph_rag", "mix").otherwise("local")
    return rows.select("collection_id", "namespace_id", named.alias("name"), strategy.alias("strategy"), mode.alias("default_query_mode"), text.graph_name(F.col("name"), F.col("collection_id")).alias("graph"))


def renamed(collections: DataFrame, old: str, new: str) -> DataFrame:
    """Collections after a rename of a root: its meta collections of all levels go along."""
    own = text.meta_root(F.col("name")) == old
    return collections.withColumn("name", F.when(own, F.concat(F.lit(new), F.substring("name", F.lit(len(old) + 1), F.length("name")))).otherwise(F.col("name")))


def descendants(collections: DataFrame) -> DataFrame:
    """(root, name, level) of all meta collections under their roots."""
    rows = collections.select(text.meta_root(F.col("name")).alias("root"), "name", text.meta_level(F.col("name")).alias("level"))
    return rows.where("level > 0")


def deleted(collections: DataFrame, root: str) -> DataFrame:
    """Collections after the deletion of a root and all levels above it."""
    return collections.where(text.meta_root(F.col("name")) != root)


def reset(table: DataFrame, collections: DataFrame) -> DataFrame:
    """A table without the rows of some collections (collection_id)."""
    return table.join(collections.select("collection_id").distinct(), "collection_id", "left_anti")


def dispatch_limit(embedding_limit: Column, model_limit: Column) -> Column:
    """The lesser of two limits, of those that are set; 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(F.least(embedding_limit, model_limit), F.lit(1)))


def region_batch(embedding_limit: Column, model_limit: Column) -> Column:
    """The lesser of two limits that must both be set."""
    missing = embedding_limit.isNull() | model_limit.isNull()
    return F.when(missing, F.raise_error(F.lit("both profiles need a limit")).cast("int")).otherwise(F.greatest(F.lit(1), F.least(embedding_limit, model_limit)))


def raw_extractions(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """(chunk_hash, domain, source, target, rel_type, weight, keywords) from cached extractions of (chunk_hash, domain); no domain matches none only."""
    kind = "array<struct<source_name:string,target_name:string,description:string,keywords:array<string>,weight:double,rel_type:string>>"
    hit = cached.withColumnRenamed("chunk_hash", "_hash").withColumnRenamed("domain", "_domain")
    rows = chunks.join(hit, (F.col("chunk_hash") == F.col("_hash")) & F.col("domain").eqNullSafe(F.col("_domain"))).select("chunk_hash", "domain", F.explode(F.from_json("relationships_json", kind)).alias("r"))
    return rows.select("chunk_hash", "domain", F.col("r.source_name").alias("source"), F.col("r.target_name").alias("target"), F.coalesce("r.rel_type", F.lit("RELATES_TO")).alias("rel_type"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), F.coalesce("r.keywords", F.array().cast("array<string>")).alias("keywords"))


def semantic_text(nodes: DataFrame, edges: DataFrame, most_nodes: int = 8, most_edges: int = 10) -> DataFrame:
    """(chat_id, context): the first nodes (chat_id, name, description) and edges (chat_id, source, target, description) of each chat as lines."""
    note = F.trim(F.coalesce("description", F.lit("")))
    line = F.when(note != "", F.concat(F.lit("Entity: "), F.trim("name"), F.lit(". "), note)).otherwise(F.concat(F.lit("Entity: "), F.trim("name")))
    order = F.row_number().over(store.Window.partitionBy("chat_id").orderBy("name"))
    top = nodes.where(F.trim("name") != "").withColumn("n", order).where(F.col("n") <= most_nodes).select("chat_id", F.lit(0).alias("k"), "n", line.alias("line"))
    bare = lambda c: F.regexp_replace(c, "^entity:", "")
    place = F.row_number().over(store.Window.partitionBy("chat_id").orderBy("source", "target"))
    said = F.concat(F.lit("Relationship: "), bare("source"), F.lit(" -> "), bare("target"), F.lit(". "), note)
    more = edges.withColumn("n", place).where((F.col("n") <= most_edges) & (note != "")).select("chat_id", F.lit(1).alias("k"), "n", said.alias("line"))
    rows = top.unionByName(more).groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("k", "n", "line"))).alias("l"))
    return rows.select("chat_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def rewritten(questions: DataFrame, rewrite=None) -> DataFrame:
    """(chat_id, question): without a context, without a model or with a blank answer the question itself, else what ``rewrite(question, context)`` makes of it."""
    context = F.trim(F.coalesce("context", F.lit("")))
    if rewrite is None:
        return questions.select("chat_id", "question")
    told = F.pandas_udf(lambda q, c: q.combine(c, rewrite), "string")(F.col("question"), F.col("context"))
    return questions.select("chat_id", F.when(context == "", F.col("question")).otherwise(F.coalesce(F.nullif(F.trim(told), F.lit("")), "question")).alias("question"))
