"""Point lookups, guards and name hits as joins over whole tables: a set of wanted keys is one semi join, never a query per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text

from . import aggregates, extract, graph

#: Relation types that only code has (its taxonomy), and types that code shares with other domains.
CODE_ONLY = tuple(name.upper() for names in extract.TAXONOMY.values() for name in names)
CODE_COMMON = tuple("CATCHES DECORATES DEFINES DEPENDS_ON GUARDS LOOPS_OVER RAISES READS RETURNS WRITES".split())


def by_keys(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are wanted."""
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def exists(wanted: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, found) of each wanted key."""
    hit = rows.select(*keys).distinct().withColumn("found", F.lit(True))
    return wanted.select(*keys).distinct().join(hit, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key."""
    return aggregates.top_per(rows, keys, order, 1, "_n").drop("_n")


def vectors_of_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors that were stored as text ``[x, y, ...]`` as arrays; what can't be read is null."""
    return rows.withColumn(column, F.from_json(column, "array<double>"))


def dimensions(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, dimensions): the length of a collection's vectors."""
    return vectors.where(F.size(column) > 0).groupBy(key).agg(F.max(F.size(column)).alias("dimensions"))


def node_records(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their aliases, sorted, each once, blanks dropped; references to base entities aren't nodes."""
    named = aliases.where(F.trim("alias_name") != "").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias_name")).alias("aliases"))
    kept = entities.where(F.col("primary_type").isNull() | (F.col("primary_type") != "base_entity_ref"))
    return kept.join(named, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def by_name(named: DataFrame) -> DataFrame:
    """(name, neighbour, rel_id, rel_type): edges from both ends, keyed by name."""
    rows = named.select(F.col("source_name").alias("src"), F.col("target_name").alias("dst"), "rel_id", "rel_type")
    return graph.symmetric(rows).select(F.col("node").alias("name"), "neighbour", "rel_id", "rel_type")


def from_message(rows: DataFrame, message_ids: DataFrame, listed: str = "source_ids") -> DataFrame:
    """Rows whose list of source messages (a JSON text or a bare id) names one of ``message_ids``."""
    ids = message_ids.select("message_id").distinct()
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    hit = marked.select("_row", F.explode(text.parse_source_ids(F.col(listed))).alias("message_id")).join(ids, "message_id", "left_semi").select("_row").distinct()
    return marked.join(hit, "_row", "left_semi").drop("_row")


def described_in(relations: DataFrame, descriptions: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations that have a description in one of some documents (document_id)."""
    return by_keys(relations, by_keys(descriptions, documents, "document_id"), "rel_id")


def word_hits(questions: DataFrame, entities: DataFrame, aliases: DataFrame, keywords: int = 5, rows: int = 5) -> DataFrame:
    """(question_id, keyword, entity_id, rank): aliases that hold a keyword as a whole word, ``rows`` of each of the first keywords.

    A keyword of one word is a token of the alias, so it is an equi-join; the
    question itself, which is the first keyword, hits equal aliases. Only the
    first ``rows`` aliases of a token can be shown, so no more are joined.
    """
    asked = questions.select("question_id", F.explode(F.slice(text.query_keywords(F.col("question")), 1, keywords)).alias("keyword"))
    known = by_keys(aliases.withColumnRenamed("entity_id", "id"), entities, "id")
    token = F.explode(F.array_distinct(F.concat(F.split(F.lower("alias_name"), " "), F.array(F.lower("alias_name")))))
    asked = asked.withColumn("token", F.lower("keyword"))
    known = by_keys(known.select("id", "alias_name", token.alias("token")), asked, "token")
    hits = asked.join(aggregates.top_per(known, ["token"], [F.col("alias_name"), F.col("id")], rows), "token")
    return aggregates.top_per(hits.select("question_id", "keyword", F.col("id").alias("entity_id"), "alias_name"), ["question_id", "keyword"], [F.col("alias_name"), F.col("entity_id")], rows).drop("alias_name")


#: Pairs of a key that one task joins.
PAIRS = 1_000_000


def exact_hits(questions: DataFrame, entities: DataFrame, aliases: DataFrame, descriptions: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(question_id, entity_id, via): what a bare question names, by name or by alias; with ``descriptions`` also the ``most`` weightiest of each entity, and their rank.

    As many rows as a key has questions times entities: they leave the join as
    they are, and nothing is shuffled after it. A question meets an entity at
    the least of the keys they share, so no pair comes twice; a key with many
    pairs is cut into slices of its questions.
    """
    asked = questions.select("question_id", text.strip_question_prefix(F.col("question")).alias("_key")).where(F.col("_key").isNotNull())
    named = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("_key"), F.lit("name").alias("via"))
    named = named.unionByName(aliases.select("entity_id", F.lower("alias_name").alias("_key"), F.lit("alias").alias("via")))
    keys = asked.groupBy("_key").agg(F.count("*").alias("_q")).join(named.groupBy("_key").agg(F.count("*").alias("_e")), "_key")
    keys = keys.select("_key", F.ceil(F.col("_q") * F.col("_e") / PAIRS).alias("_slices"))
    each = lambda rows, by, kept: rows.groupBy(*by).agg(F.collect_set("_key").alias(kept)).withColumn("_key", F.explode(kept)).join(keys, "_key")
    left = each(asked, ["question_id"], "_asked").withColumn("_slice", F.pmod(F.xxhash64("question_id"), "_slices")).drop("_slices")
    right = each(by_keys(named, keys, "_key"), ["entity_id", "via"], "_named").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))).drop("_slices")
    shown = ["question_id", "entity_id", "via"]
    if descriptions is not None:
        best = aggregates.top_per(by_keys(descriptions, right, "entity_id"), ["entity_id"], _weightiest(), most)
        right = right.join(best.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("rank", "description"))).alias("_told")), "entity_id")
    one = (F.size("_asked") == 1) | (F.size("_named") == 1) | (F.array_min(F.array_intersect("_asked", "_named")) == F.col("_key"))
    hits = left.join(right, ["_key", "_slice"]).where(one)
    return hits.select(*shown) if descriptions is None else hits.select(*shown, F.explode("_told").alias("_t")).select(*shown, "_t.description", "_t.rank")


def _weightiest() -> list[Column]:
    return [F.desc("weight"), F.col("description"), F.col("document_id")]


def with_descriptions(hits: DataFrame, descriptions: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Hits with their ``most`` weightiest descriptions and their rank."""
    return hits.join(aggregates.top_per(descriptions, [key], _weightiest(), most), key)


def name_variants(names: DataFrame, entities: DataFrame, aliases: DataFrame, score: float = 0.96) -> DataFrame:
    """(entity_id, score) of all entities with one of some names (name) as name or alias, case aside."""
    keys = names.where(F.trim("name") != "").select(F.lower("name").alias("_key")).distinct()
    every = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("_key")).unionByName(aliases.select("entity_id", F.lower("alias_name").alias("_key")))
    return every.join(keys, "_key", "left_semi").select("entity_id").distinct().withColumn("score", F.lit(score))


def same_tenant(owner: Column, tenant: Column | None) -> Column:
    """Whether a row may be seen: without a tenant all rows, else its own."""
    return F.lit(True) if tenant is None else owner.eqNullSafe(tenant)


def guarded(rows: DataFrame, owner: str, tenant: str) -> DataFrame:
    """The rows; an error as soon as one of another tenant is read."""
    ok = F.when(F.col(owner).eqNullSafe(F.col(tenant)), F.lit(True)).otherwise(F.raise_error(F.lit("a row of another namespace")).cast("boolean"))
    return rows.where(ok)


def code_like(relations: DataFrame, key: str) -> DataFrame:
    """(key, code_like): a type that only code has, or three of those that code often has."""
    kinds = relations.where(F.trim("rel_type") != "").groupBy(key).agg(F.collect_set(F.upper("rel_type")).alias("kinds"))
    of = lambda names: F.size(F.array_intersect("kinds", F.array(*[F.lit(n) for n in names])))
    return kinds.select(key, ((of(CODE_ONLY) > 0) | (of(CODE_COMMON) >= 3)).alias("code_like"))


def mean_over(scores: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, mean): mean score of the nodes of each group; a node without a score counts as 0."""
    return members.join(scores, "id", "left").groupBy(group).agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean"))


def messages_by_id(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages of some (conv_id, turn), in their order inside each chat."""
    found = by_keys(messages, wanted, "conv_id", "turn")
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
