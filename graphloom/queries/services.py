"""Lookups, relation types, ingestion, jobs, collections, chats and prompts over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import prompts, text as T, udfs as U
from graphloom.operators import aggregates as A, chat, extract as X, graph as G, ingest as I, jobs as J, lookups as L, prepare as P, reltypes as R, service as S
from graphloom.queries.relational import INDEX_SQL, QUESTIONS, _key, questions
from graphloom.queries.scalar import COLLECTION, _dashed, _words
from graphloom.sources import descriptions as D, store, tables as V
from graphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _joined(c: str) -> F.Column:
    return F.array_join(c, "|")


# lookups
@query(f"WITH {V.RELATIONS_SQL} SELECT DISTINCT rel_type, CAST(length(rel_type) AS DOUBLE) AS x, CAST(1.5 AS DOUBLE) AS y FROM relations")
def scan_prefix_embeddings(spark, sf):
    rows = V.relations(spark, sf).select("rel_type").distinct().withColumn("embedding", F.concat(F.lit("["), F.length("rel_type"), F.lit(", 1.5]")))
    return L.vectors_of_text(rows).select("rel_type", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)")
def lookup_centroid(spark, sf):
    return L.by_keys(table(spark, sf, "embeddings").select("vec_id", "label"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vec_id")), "vec_id")


@query("SELECT sha256(text) AS chunk_hash, doc_id AS document_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def lookup_chunks_by_hash(spark, sf):
    chunks = V.chunks(spark, sf)
    bad = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return L.by_keys(chunks, L.by_keys(chunks, bad, "document_id"), "chunk_hash").select("chunk_hash", "document_id")


@query(f"WITH {V.ENTITIES_SQL} SELECT DISTINCT 'customer:' || CAST(user_id AS VARCHAR) AS id, 'customer:' || CAST(user_id AS VARCHAR) IN (SELECT id FROM entities) AS found FROM events")
def has_node(spark, sf):
    return L.exists(table(spark, sf, "events").select(F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("id")), V.entities(spark, sf), "id")


_RECORDS = f"{V.ENTITIES_SQL}, {V.ALIASES_SQL}, al AS (SELECT entity_id, array_to_string(list_sort(list(DISTINCT alias_name)), '|') AS aliases FROM aliases GROUP BY 1)"


@query(f"WITH {_RECORDS} SELECT id, name, primary_type, coalesce(aliases, '') AS aliases FROM entities LEFT JOIN al ON entity_id = id")
def get_node(spark, sf):
    return L.node_records(V.entities(spark, sf), V.entity_aliases(spark, sf)).select("id", "name", "primary_type", _joined("aliases").alias("aliases"))


@query(f"WITH {V.ENTITIES_SQL} SELECT count(*) AS n FROM entities")
def node_count(spark, sf):
    return V.entities(spark, sf).agg(F.count("*").alias("n"))


@query(f"WITH {V.ENTITIES_SQL} SELECT DISTINCT p_name AS name, p_name IN (SELECT name FROM entities) AS found FROM part")
def has_lightrag_node(spark, sf):
    return L.exists(table(spark, sf, "part").select(F.col("p_name").alias("name")), V.entities(spark, sf), "name")


@query(f"WITH {V.ENTITIES_SQL} SELECT name, min(id) AS id, arg_min(primary_type, id) AS primary_type FROM entities WHERE name IN (SELECT s_name FROM supplier) GROUP BY name")
def get_lightrag_node(spark, sf):
    wanted = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return L.first_of(L.by_keys(V.entities(spark, sf), wanted, "name"), ["name"], [F.col("id")]).select("name", "id", "primary_type")


@query(f"WITH {V.NAMED_SQL} SELECT source_name, target_name, min(rel_id) AS rel_id FROM named GROUP BY 1, 2")
def get_lightrag_edge(spark, sf):
    return L.first_of(V.named_relations(spark, sf), ["source_name", "target_name"], [F.col("rel_id")]).select("source_name", "target_name", "rel_id")


@query(f"WITH {V.NAMED_SQL} SELECT source_name AS name, target_name AS neighbour, rel_id FROM named WHERE source_name IN (SELECT s_name FROM supplier) UNION ALL SELECT target_name, source_name, rel_id FROM named WHERE target_name IN (SELECT s_name FROM supplier)")
def lightrag_neighbours(spark, sf):
    return L.by_keys(L.by_name(V.named_relations(spark, sf)), table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "name").select("name", "neighbour", "rel_id")


@query("SELECT label, max(len(embedding)) AS dimensions FROM embeddings GROUP BY label")
def collection_dimension(spark, sf):
    return L.dimensions(table(spark, sf, "embeddings"), "label")


@query(f"WITH {V.RELATIONS_SQL}, {D.RELATION_SQL} SELECT rel_id FROM relations WHERE rel_id IN (SELECT rel_id FROM rdesc WHERE document_id IN (SELECT s_suppkey FROM supplier))")
def rel_has_description(spark, sf):
    return L.described_in(V.relations(spark, sf), D.relation_descriptions(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id"))).select("rel_id")


_MESSAGES = "SELECT o_orderkey, '[\"m' || CAST(o_custkey AS VARCHAR) || '\", \"' || o_orderstatus || '\"]' AS source_ids FROM orders"


def _listed(spark, sf) -> DataFrame:
    ids = F.concat(F.lit('["m'), F.col("o_custkey").cast("string"), F.lit('", "'), "o_orderstatus", F.lit('"]'))
    return table(spark, sf, "orders").select("o_orderkey", ids.alias("source_ids"))


@query(f"SELECT o_orderkey FROM ({_MESSAGES}) WHERE EXISTS (SELECT 1 FROM supplier WHERE source_ids LIKE '[\"m' || CAST(s_suppkey AS VARCHAR) || '\"%')")
def nodes_by_message(spark, sf):
    return L.from_message(_listed(spark, sf), table(spark, sf, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("message_id"))).select("o_orderkey")


@query("SELECT o_orderkey, 'customer:' || CAST(o_custkey AS VARCHAR) AS src FROM orders WHERE o_orderstatus = 'F'")
def edges_by_message(spark, sf):
    edges = _listed(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src")), "o_orderkey")
    return L.from_message(edges, spark.createDataFrame([("F",)], "message_id string")).select("o_orderkey", "src")


_KW = f"list_filter(list_transform({_words('question')}, lambda w: lower(regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g'))), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in T.STOP_SHORT)}], w))"


@query(f"""WITH {V.ALIASES_SQL}, q AS ({QUESTIONS}), k AS (SELECT question_id, unnest(list_concat([question], {_KW})[1:5]) AS keyword FROM q),
t AS (SELECT entity_id, alias_name, unnest(list_distinct(list_append(string_split(lower(alias_name), ' '), lower(alias_name)))) AS token FROM aliases)
SELECT question_id, keyword, entity_id, rank FROM (SELECT question_id, keyword, entity_id, row_number() OVER (PARTITION BY question_id, keyword ORDER BY alias_name, entity_id) AS rank FROM k JOIN t ON lower(keyword) = token) WHERE rank <= 5""")
def word_boundary_ilike(spark, sf):
    return L.word_hits(questions(spark, sf), V.entities(spark, sf), V.entity_aliases(spark, sf))


def _part_questions(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("question"))


_HITS = "hits AS (SELECT DISTINCT p_partkey AS question_id, entity_id, via FROM part JOIN (SELECT id AS entity_id, lower(name) AS k, 'name' AS via FROM entities UNION ALL SELECT entity_id, lower(alias_name), 'alias' FROM aliases) ON lower(p_name) = k)"


@query(f"WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL}, {_HITS} SELECT * FROM hits")
def exact_name_hits(spark, sf):
    return L.exact_hits(_part_questions(spark, sf), V.entities(spark, sf), V.entity_aliases(spark, sf))


@query(f"WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL}, {_HITS}, {D.ENTITY_SQL} SELECT question_id, entity_id, via, description, rank FROM (SELECT hits.*, description, row_number() OVER (PARTITION BY question_id, hits.entity_id, via ORDER BY weight DESC, description, document_id) AS rank FROM hits JOIN edesc ON edesc.entity_id = hits.entity_id) WHERE rank <= 4")
def exact_hits_with_descriptions(spark, sf):
    return L.exact_hits(_part_questions(spark, sf), V.entities(spark, sf), V.entity_aliases(spark, sf), D.entity_descriptions(spark, sf))


@query(f"WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL} SELECT DISTINCT entity_id, CAST(0.96 AS DOUBLE) AS score FROM (SELECT id AS entity_id, lower(name) AS k FROM entities UNION ALL SELECT entity_id, lower(alias_name) FROM aliases) WHERE k IN (SELECT lower(p_name) FROM part UNION ALL SELECT lower(n_name) FROM nation)")
def base_ids_for_names(spark, sf):
    names = table(spark, sf, "part").select(F.upper("p_name").alias("name")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    return L.name_variants(names, V.entities(spark, sf), V.entity_aliases(spark, sf))


@query("SELECT c_custkey FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_nationkey = s_nationkey")
def tenant_guard(spark, sf):
    pairs = table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("c_custkey"))
    own = pairs.where(L.same_tenant(F.col("c_nationkey"), F.col("s_nationkey")))
    return L.guarded(own, "c_nationkey", "s_nationkey").select("c_custkey")


_CODE = "CASE WHEN event_type = 'error' AND value > 20 THEN 'call' WHEN event_type = 'click' THEN 'DEFINES' WHEN event_type = 'view' THEN 'reads' ELSE event_type END"


@query(f"SELECT user_id, count(*) FILTER (k IN ({', '.join(repr(k) for k in L.CODE_ONLY)})) > 0 OR count(DISTINCT k) FILTER (k IN ({', '.join(repr(k) for k in L.CODE_COMMON)})) >= 3 AS code_like FROM (SELECT user_id, upper({_CODE}) AS k FROM events) GROUP BY user_id")
def is_code_like(spark, sf):
    return L.code_like(table(spark, sf, "events").select("user_id", F.expr(_CODE).alias("rel_type")), "user_id")


@query("SELECT n_regionkey AS grp, round(avg(coalesce(s, 0.0)), 6) AS mean FROM nation LEFT JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS s FROM supplier GROUP BY 1) ON k = n_nationkey GROUP BY 1")
def mean_over_set(spark, sf):
    scores = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.max("s_acctbal").alias("score"))
    return L.mean_over(scores, table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp")), "grp")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM conversations WHERE role = 'assistant'")
def messages_by_id(spark, sf):
    rows = table(spark, sf, "conversations")
    return L.messages_by_id(rows, rows.where("role = 'assistant'")).select("conv_id", "turn", "ord")


# relation types
@query(f"WITH a(alias_type, canonical_type) AS (VALUES {', '.join(str(x) for x in V.ALIASES.items())}) SELECT * FROM a")
def type_alias_map(spark, sf):
    raw = V.relation_aliases(spark).select(F.lower("alias_type").alias("alias_type"), F.replace("canonical_type", F.lit("_"), F.lit(" ")).alias("canonical_type"))
    return R.alias_map(raw.unionByName(spark.createDataFrame([("", "X"), ("Y", " ")], raw.schema)))


@query(f"WITH {V.RELATIONS_SQL}, d AS (SELECT DISTINCT rel_type FROM relations) SELECT row_number() OVER (ORDER BY own, rel_type) - 1 AS ord, rel_type FROM (SELECT 'RELATES_TO' AS rel_type, 0 AS own UNION ALL SELECT rel_type, 1 FROM d)")
def active_dimensions(spark, sf):
    rows = V.relations(spark, sf)
    asked = rows.withColumn("rel_type", F.when(F.col("rel_type") == "PLACED", "ORDERED").otherwise(F.col("rel_type")))
    return R.active_dimensions(asked, V.relation_aliases(spark))


@query("SELECT DISTINCT user_id AS collection_id, upper(event_type) AS canonical_type FROM events WHERE event_type NOT IN ('click', 'view')")
def get_or_create_type(spark, sf):
    rows = table(spark, sf, "events")
    types = rows.where("event_type in ('click', 'view')").select(F.col("user_id").alias("collection_id"), F.upper("event_type").alias("canonical_type")).distinct()
    return R.created(types, rows.select(F.col("user_id").alias("collection_id"), F.col("event_type").alias("rel_type")))


_SEEN = "SELECT user_id % 10 AS type_id, event_type AS alias_type, count(*) AS n FROM events GROUP BY ALL"


@query(f"WITH c AS (SELECT type_id, alias_type, CAST(sum(n) AS BIGINT) AS frequency FROM ({_SEEN} UNION ALL SELECT DISTINCT user_id % 10, 'click', 5 FROM events) GROUP BY 1, 2) SELECT c.*, (SELECT arg_min(alias_type, (-frequency, alias_type)) FROM c d WHERE d.type_id = c.type_id) AS canonical_type FROM c")
def observe_type(spark, sf):
    seen = table(spark, sf, "events").select((F.col("user_id") % 10).alias("type_id"), F.col("event_type").alias("alias_type"))
    old = seen.select("type_id").distinct().withColumns({"alias_type": F.lit("click"), "frequency": F.lit(5).cast("bigint")})
    return R.observed(old, seen)


@query(f"WITH {V.RELATIONS_SQL} SELECT src, dst, rel_type, CAST(least(sum(weight), 100) AS INTEGER) AS weight FROM (SELECT src, dst, weight, CASE rel_type WHEN 'SUPPLIES' THEN 'DELIVERS' WHEN 'PLACED' THEN 'BUYS' ELSE rel_type END AS rel_type FROM relations) GROUP BY ALL")
def reelect_edges(spark, sf):
    """Elections that rename two types, with the edges that follow."""
    types = spark.createDataFrame([(0, "SUPPLIES"), (1, "PLACED"), (2, "CONTAINS")], "type_id int, canonical_type string")
    aliases = spark.createDataFrame([(0, "SUPPLIES", 2), (0, "DELIVERS", 3), (1, "PLACED", 4), (1, "BUYS", 4), (2, "CONTAINS", 1)], "type_id int, alias_type string, frequency bigint")
    return R.reelected(types, aliases, V.relations(spark, sf))[1]


@query(f"WITH {V.RELATIONS_SQL}, t AS (SELECT DISTINCT rel_type AS canonical_type FROM relations WHERE rel_type <> 'PLACED' UNION ALL SELECT 'UNUSED') SELECT canonical_type AS type_id, canonical_type, canonical_type AS alias_type, greatest(1, (SELECT count(*) FROM relations WHERE rel_type = canonical_type)) AS frequency FROM t")
def backfill_types(spark, sf):
    rows = V.relations(spark, sf)
    types = rows.select(F.col("rel_type").alias("canonical_type")).distinct().unionByName(spark.createDataFrame([("UNUSED",)], "canonical_type string")).withColumn("type_id", F.col("canonical_type"))
    return R.backfilled(types, spark.createDataFrame([("PLACED",)], "type_id string"), rows)


@query("SELECT o_orderkey, n.s AS o_orderstatus FROM orders JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1) n ON k = o_orderkey WHERE o_orderstatus IS DISTINCT FROM n.s")
def backfill_update(spark, sf):
    truth = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return R.corrected(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), truth, "o_orderkey", "o_orderstatus")


@query()
def resolve_rel_type(spark, sf):
    """Events as observations, a collection per user; labels get a suffix, so that likeness has something to find."""
    label = F.concat_ws("_", F.col("event_type"), F.when(F.col("value") > 10, "of things").otherwise("of the things"))
    return R.resolved_types(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("collection_id"), F.col("event_id").alias("seq"), label.alias("rel_type")))


_COUNTS = "SELECT upper(event_type) || CASE WHEN value > 10 THEN '_OF_A_THING' ELSE '_OF_THING' END AS rel_type, count(*) AS n FROM events GROUP BY 1"


def _type_counts(spark, sf) -> DataFrame:
    label = F.concat(F.upper("event_type"), F.when(F.col("value") > 10, "_OF_A_THING").otherwise("_OF_THING"))
    return table(spark, sf, "events").groupBy(label.alias("rel_type")).agg(F.count("*").alias("n"))


@query(f"WITH c AS ({_COUNTS}) SELECT rel_type, (SELECT arg_max(d.rel_type, (d.n, d.rel_type)) FROM c d WHERE split_part(d.rel_type, '_', 1) = split_part(c.rel_type, '_', 1)) AS representative FROM c")
def cluster_rel_types(spark, sf):
    return R.clustered(_type_counts(spark, sf), 0.8)


@query(f"WITH c AS ({_COUNTS}), m AS (SELECT *, (SELECT arg_max(d.rel_type, (d.n, d.rel_type)) FROM c d WHERE split_part(d.rel_type, '_', 1) = split_part(c.rel_type, '_', 1)) AS representative FROM c) SELECT representative, array_to_string(list_sort(list(rel_type)), '|') AS members, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY 1")
def summarise_type_groups(spark, sf):
    counts = _type_counts(spark, sf)
    return R.summarised(counts, R.clustered(counts, 0.8)).withColumn("members", _joined("members"))


_SIGN = "SELECT DISTINCT source_name AS n, 'o|' || rel_type || '|' || target_name AS token FROM named UNION SELECT DISTINCT target_name, 'i|' || source_name || '|' || rel_type FROM named"


def _similar(sign: str) -> str:
    return f"""tok AS ({sign}), sz AS (SELECT n, count(*) AS size FROM tok GROUP BY n),
p AS (SELECT x.n AS a, y.n AS b, count(*) AS overlap FROM tok x JOIN tok y ON x.token = y.token AND x.n < y.n GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT a, b, overlap, s.size AS size_a, t.size AS size_b FROM p JOIN sz s ON s.n = a JOIN sz t ON t.n = b)
SELECT a, b, overlap, round(overlap / sqrt(size_a * size_b), 6) AS cosine, round(overlap / (size_a + size_b - overlap), 6) AS jaccard FROM m WHERE overlap / sqrt(size_a * size_b) >= 0.2 AND overlap / (size_a + size_b - overlap) >= 0.1"""


@query(f"WITH {V.NAMED_SQL}, {_similar(_SIGN)}")
def typed_similarity(spark, sf):
    from graphloom.operators import analytics as N

    return N.typed_pairs(V.named_relations(spark, sf)).select("a", "b", "overlap", "cosine", "jaccard")


_GROUPED = "CASE WHEN rel_type IN ('CONTAINS', 'SUPPLIES') THEN 'SUPPLIES' ELSE rel_type END"


@query(f"WITH {V.NAMED_SQL}, {_similar(_SIGN.replace('rel_type', _GROUPED))}")
def grouped_similarity(spark, sf):
    from graphloom.operators import analytics as N

    mapping = spark.createDataFrame([("CONTAINS", "SUPPLIES")], "rel_type string, representative string")
    return N.typed_pairs(V.named_relations(spark, sf), mapping).select("a", "b", "overlap", "cosine", "jaccard")


@query(f"WITH {V.NAMED_SQL}, i AS (SELECT source_name AS anchor, 'out' AS direction, * FROM named UNION ALL SELECT target_name, 'in', * FROM named) SELECT anchor, rel_type, rel_id, direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor, rel_type ORDER BY weight DESC, source_name, target_name, rel_id, direction) AS rank FROM i) WHERE rank <= 5 AND anchor IN (SELECT n_name FROM nation)")
def anchor_payload(spark, sf):
    """The five best edges of each type of every nation."""
    named = V.named_relations(spark, sf)
    both = named.withColumns({"anchor": F.col("source_name"), "direction": F.lit("out")}).unionByName(named.withColumns({"anchor": F.col("target_name"), "direction": F.lit("in")}))
    kept = both.join(F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("anchor")).distinct()), "anchor", "left_semi")
    return A.top_per(kept, ["anchor", "rel_type"], [F.desc("weight"), F.col("source_name"), F.col("target_name"), F.col("rel_id"), F.col("direction")], 5).select("anchor", "rel_type", "rel_id", "direction", "rank")


@query(f"WITH {V.NAMED_SQL} SELECT source_name AS name, rel_type, count(*) AS n FROM named GROUP BY ALL")
def load_raw_graph(spark, sf):
    """The raw edges by name, without types of their own, as counts."""
    return V.named_relations(spark, sf).groupBy(F.col("source_name").alias("name"), "rel_type").agg(F.count("*").alias("n"))


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL}, f AS (SELECT id FROM entities WHERE contains(lower(name), 'ring')) SELECT rel_id, CAST(greatest(weight, 1) AS DOUBLE) AS weight FROM relations WHERE src IN (SELECT id FROM f) OR dst IN (SELECT id FROM f)")
def metric_region(spark, sf):
    """The region around all entities that a term names."""
    focus = V.entities(spark, sf).where(F.lower("name").contains("ring")).select(F.col("id").alias("node"))
    return G.touching(V.relations(spark, sf), focus).select("rel_id", F.greatest("weight", F.lit(1)).cast("double").alias("weight"))


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL} SELECT id, name, CAST(n AS DOUBLE) AS score FROM (SELECT src AS id, count(*) AS n FROM relations GROUP BY 1) JOIN entities USING (id) ORDER BY score DESC, id LIMIT 12")
def top_named(spark, sf):
    from graphloom.operators import analytics as N

    scores = V.relations(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return N.top_named(scores, V.entities(spark, sf)).select("id", "name", "score")


# descriptions
@query(f"WITH {D.ENTITY_SQL} SELECT entity_id, description, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, description, document_id) AS rank FROM edesc) WHERE rank <= 4")
def entity_descriptions(spark, sf):
    return A.top_per(D.entity_descriptions(spark, sf), ["entity_id"], [F.desc("weight"), F.col("description"), F.col("document_id")], 4).select("entity_id", "description", "rank")


@query(f"WITH {V.NAMED_SQL}, {D.RELATION_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY weight DESC, description, document_id) AS rank FROM rdesc) WHERE rank <= 4) SELECT named.rel_id, rank, source_name || ' -[' || rel_type || ']-> ' || target_name || ': ' || description AS line FROM named JOIN r ON r.rel_id = named.rel_id")
def relation_lines(spark, sf):
    best = A.top_per(D.relation_descriptions(spark, sf), ["rel_id"], [F.desc("weight"), F.col("description"), F.col("document_id")], 4)
    line = F.concat("source_name", F.lit(" -["), "rel_type", F.lit("]-> "), "target_name", F.lit(": "), "description")
    return V.named_relations(spark, sf).join(best.select("rel_id", "description", "rank"), "rel_id").select("rel_id", "rank", line.alias("line"))


@query("SELECT l_partkey AS rel_id, l_suppkey AS document_id, arg_min(l_returnflag || l_linestatus, (l_orderkey, l_linenumber)) AS description, count(*) AS weight FROM (SELECT DISTINCT ON (l_partkey, l_suppkey, l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_returnflag || l_linestatus) GROUP BY 1, 2")
def add_rel_description(spark, sf):
    flag = F.concat("l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("rel_id"), F.col("l_suppkey").alias("document_id"), F.struct("l_orderkey", "l_linenumber").alias("seq")).agg(F.min(flag).alias("description"))
    seen = lines.withColumn("chunk_hash", F.md5(F.to_json("seq")))
    old = spark.createDataFrame([], "rel_id bigint, document_id bigint, description string, weight bigint, hashes array<string>")
    return I.described(old, seen).select("rel_id", "document_id", "description", "weight")


# ingestion
def _reader(content: str, known: list) -> str:
    """A stand-in for a model: every word in capitals is related to the word after it."""
    words = content.split()
    pairs = list(dict.fromkeys((a, b) for a, b in zip(words, words[1:], strict=False) if a.isupper() and len(a) > 1))
    return json.dumps({"relationships": [] if known else [{"source": a, "target": {"name": b, "description": a.lower()}, "rel_type": "precedes", "weight": 0.5, "keywords": [a]} for a, b in pairs]})


def _chunks(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents")
    return I.identified(rows.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit(0).alias("chunk_index")), F.lit(COLLECTION))


_CLEAN = "substr(regexp_replace(nfc_normalize(text), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}]', '', 'g'), 1, 16000)"


@query(f"SELECT chunk_hash, len({_words('c')}) AS token_count FROM (SELECT DISTINCT sha256({_CLEAN}) AS chunk_hash, {_CLEAN} AS c FROM documents)")
def ingest_vector(spark, sf):
    return I.vector_rows(_chunks(spark, sf)).select("chunk_hash", "token_count")


@query()
def ingest_graph(spark, sf):
    nodes, edges = I.graph_rows(I.triples(_chunks(spark, sf), _reader))
    return edges.select("a", "b", "rel_type", "weight", _joined("keywords").alias("keywords"))


@query()
def ingest_graph_nodes(spark, sf):
    return I.graph_rows(I.triples(_chunks(spark, sf), _reader))[0]


@query()
def ingest_lightrag(spark, sf):
    nodes, _ = I.named_rows(I.triples(_chunks(spark, sf), _reader))
    return nodes.select("name", "type", "description", F.size("source_ids").alias("n_sources"))


@query()
def append_ledger(spark, sf):
    chunks = _chunks(spark, sf)
    return I.ledger(chunks, "custom_graph_rag", I.triples(chunks, _reader)).select("chunk_id", "chunk_hash", "strategy", "entity_count", "relationship_count", "severity")


@query("SELECT sha256(text) AS chunk_hash, lang AS domain, 'a' AS source, source AS target, 'RELATES_TO' AS rel_type, CAST(1.0 AS DOUBLE) AS weight FROM documents")
def scan_raw_extraction(spark, sf):
    rows = table(spark, sf, "documents").withColumn("chunk_hash", T.sha256_hex(F.col("text")))
    saved = rows.groupBy("chunk_hash", F.col("lang").alias("domain")).agg(F.min("source").alias("_s"), F.count_distinct("source").alias("_n"))
    cached = saved.select("chunk_hash", "domain", F.concat(F.lit('[{"source_name": "a", "target_name": "x"}]')).alias("relationships_json"))
    return S.raw_extractions(rows.select("chunk_hash", F.col("lang").alias("domain"), "source"), cached).select("chunk_hash", "domain", "source", F.lit(None).cast("string").alias("target"), "rel_type", "weight").drop("target")


SQL["scan_raw_extraction"] = "SELECT sha256(text) AS chunk_hash, lang AS domain, 'a' AS source, 'RELATES_TO' AS rel_type, CAST(1.0 AS DOUBLE) AS weight FROM documents"


@query("SELECT chunk_hash FROM (SELECT DISTINCT sha256(text) AS chunk_hash, lang FROM documents WHERE source <> 'src0') WHERE (chunk_hash, lang) NOT IN (SELECT sha256(text), lang FROM documents WHERE source = 'src0')")
def save_raw_extraction(spark, sf):
    rows = table(spark, sf, "documents").select(T.sha256_hex(F.col("text")).alias("chunk_hash"), F.col("lang").alias("domain"), "source", "doc_id")
    return store.insert_absent(rows.where("source = 'src0'"), rows.where("source <> 'src0'"), ["chunk_hash", "domain"], "doc_id").select("chunk_hash")


# sinks
@query("SELECT sha256(text) AS chunk_hash, min(doc_id) AS document_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY 1")
def upsert_chunk_embedding(spark, sf):
    chunks = V.chunks(spark, sf)
    return store.insert_absent(chunks.where("lang = 'en'"), chunks, ["chunk_hash"], "document_id").select("chunk_hash", "document_id")


@query(f"WITH {D.ENTITY_SQL} SELECT entity_id, 2 * count(*) AS n FROM edesc GROUP BY 1")
def append_entity_embedding(spark, sf):
    """Appending the same rows twice keeps both."""
    rows = D.entity_descriptions(spark, sf)
    return rows.unionByName(rows).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(f"WITH {D.RELATION_SQL} SELECT rel_id, 2 * count(*) AS n FROM rdesc GROUP BY 1")
def append_relationship_embedding(spark, sf):
    rows = D.relation_descriptions(spark, sf)
    return rows.unionByName(rows).groupBy("rel_id").agg(F.count("*").alias("n"))


@query(f"WITH {V.RELATIONS_SQL}, o AS (SELECT rel_type, count(*) AS x FROM relations GROUP BY 1), n AS (SELECT rel_type, CAST(max(weight) AS BIGINT) AS x FROM relations WHERE weight > 1 GROUP BY 1) SELECT rel_type, coalesce(n.x, o.x) AS x FROM o LEFT JOIN n USING (rel_type)")
def upsert_prefix_embedding(spark, sf):
    rows = V.relations(spark, sf)
    return store.upsert(rows.groupBy("rel_type").agg(F.count("*").alias("x")), rows.where("weight > 1").groupBy("rel_type").agg(F.max("weight").cast("bigint").alias("x")), ["rel_type"])


_OLD = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer"
_NEW = "SELECT o_custkey AS id, max(o_orderpriority) AS description FROM orders GROUP BY 1"


def _old_nodes(spark, sf) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    return old, table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("description"), F.max("o_orderstatus").alias("secret"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name END AS name, CASE WHEN n.id IS NULL THEN o.description ELSE n.description END AS description FROM o FULL JOIN n ON o.id = n.id")
def upsert_nodes(spark, sf):
    """A merge in which nulls overwrite."""
    old, new = _old_nodes(spark, sf)
    return store.upsert(old, new.select("id", F.lit(None).cast("string").alias("name"), "description"), ["id"], overwrite_nulls=True)


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, name, coalesce(n.description, o.description) AS description FROM o FULL JOIN n ON o.id = n.id")
def upsert_node(spark, sf):
    return S.upsert_node(*_old_nodes(spark, sf))


@query(f"WITH {V.RELATIONS_SQL} SELECT src, dst, rel_type, CASE WHEN rel_type = 'CONTAINS' THEN 9 ELSE weight END AS weight FROM relations")
def upsert_edge(spark, sf):
    old = V.relations(spark, sf).select("src", "dst", "rel_type", "weight")
    return S.upsert_edge(old, old.where("rel_type = 'CONTAINS'").select("src", "dst", F.lit("contains").alias("rel_type"), F.lit(9).alias("weight"), F.lit("x").alias("secret")))


@query("SELECT n AS collection_id, name, coalesce(t, 'UNKNOWN') AS type FROM (SELECT c_nationkey AS n, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS t FROM customer UNION ALL SELECT s_nationkey, s_name, CASE WHEN s_acctbal > 0 THEN 'SUPPLIER' END FROM supplier)")
def upsert_lightrag_node(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_nationkey").alias("collection_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("type"))
    new = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("collection_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "SUPPLIER").alias("type"))
    return S.upsert_named_node(old, new)


@query(f"WITH {V.NAMED_SQL} SELECT source_name AS src, target_name AS dst, rel_type, CAST(max(weight) + 1 AS INTEGER) AS weight FROM named GROUP BY 1, 2, 3")
def upsert_lightrag_edge(spark, sf):
    """The same edges by name again, each a little heavier."""
    rows = V.named_relations(spark, sf).select("rel_id", F.col("source_name").alias("src"), F.col("target_name").alias("dst"), "rel_type", "weight", "keywords")
    old = rows.groupBy("src", "dst", "rel_type").agg(F.min("rel_id").alias("rel_id"), F.max("weight").alias("weight"), F.max("keywords").alias("keywords"))
    return store.upsert_edges(old, old.withColumn("weight", F.col("weight") + 1)).select("src", "dst", "rel_type", "weight")


# jobs
_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END"


def _jobs(spark, sf) -> DataFrame:
    started = F.when(F.col("event_type") == "click", F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf, "events").select(F.col("event_id").alias("job_id"), "user_id", F.expr(_STATE).alias("status"), F.lit(None).cast("string").alias("error"), started.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.concat(F.lit('{"result": '), "props", F.lit("}")).alias("payload"))


@query("SELECT event_id AS job_id, user_id AS collection_id, event_type AS kind, 'pending' AS status, props AS payload FROM events")
def submit(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("collection_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    return S.submitted(rows, "2024-01-05 00:00:00").drop("created_at")


@query(f"SELECT event_id AS job_id, {_STATE} AS status FROM events WHERE event_id IN (SELECT o_orderkey FROM orders)")
def job_get(spark, sf):
    return L.by_keys(_jobs(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id")), "job_id").select("job_id", "status")


@query("SELECT event_id AS job_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_type = 'purchase'")
def job_result(spark, sf):
    return S.results(_jobs(spark, sf)).select("job_id", F.get_json_object("result", "$.k").alias("k"))


@query(f"SELECT event_id AS job_id, CASE WHEN value > 20 THEN 'running' WHEN value > 10 THEN 'failed' ELSE {_STATE} END AS status, CASE WHEN value > 10 AND value <= 20 THEN event_type END AS error, CASE WHEN event_type = 'click' THEN ts WHEN value > 20 THEN TIMESTAMP '2024-02-01 00:00:00' END AS started_at, CASE WHEN value > 10 AND value <= 20 THEN TIMESTAMP '2024-02-01 00:00:00' END AS completed_at FROM events")
def job_status(spark, sf):
    rows = table(spark, sf, "events")
    changes = rows.where("value > 10").select(F.col("event_id").alias("job_id"), F.when(F.col("value") > 20, "running").otherwise("failed").alias("new_status"), F.when(F.col("value") <= 20, F.col("event_type")).alias("new_error"))
    return S.status_changed(_jobs(spark, sf), changes, "2024-02-01 00:00:00")


@query("SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 45)")
def mark_cancelled(spark, sf):
    rows = table(spark, sf, "events")
    return S.marked_cancelled(rows.where("event_type = 'purchase' and value > 45").select(F.col("user_id").alias("job_id")).distinct(), rows.where("event_type = 'error'").select(F.col("user_id").alias("job_id")))


@query(f"SELECT event_id AS job_id, CASE WHEN event_type IN ('purchase', 'error') THEN {_STATE} WHEN event_id IN (SELECT c_custkey FROM customer) THEN 'cancelled' ELSE {_STATE} END AS status FROM events")
def finalize_cancelled(spark, sf):
    return S.finalised(_jobs(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))).select("job_id", "status")


@query("SELECT event_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS cancelled FROM events")
def is_cancelled(spark, sf):
    rows = table(spark, sf, "events")
    marked = rows.where("event_type = 'error'").select("user_id").distinct().withColumn("hit", F.lit(True))
    return rows.join(marked, "user_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("cancelled"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def event_append(spark, sf):
    return S.events_of(table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")), table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_id")).select("event_id")


@query("SELECT coalesce(o_orderkey, l_orderkey) AS job_id, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'old' WHEN l_orderkey IS NOT NULL THEN 'new' ELSE 'old' END AS text, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END, 'pending') AS status FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def fan_out_chunks(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus"))
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("text"), status.alias("status"))
    new = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("text")).distinct()
    return J.fanned_out(old, new).select("job_id", "text", "status")


@query("SELECT p_partkey, greatest(1, coalesce(least(CASE WHEN p_size > 10 THEN p_size END, CASE WHEN p_size < 40 THEN p_size - 5 END), 1)) AS slots FROM part")
def dispatch_limit(spark, sf):
    a, b = F.when(F.col("p_size") > 10, F.col("p_size")), F.when(F.col("p_size") < 40, F.col("p_size") - 5)
    return table(spark, sf, "part").select("p_partkey", S.dispatch_limit(a, b).alias("slots"))


@query("SELECT p_partkey, greatest(1, least(p_size, 8)) AS batch FROM part")
def batch_size(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.region_batch(F.col("p_size"), F.lit(8)).alias("batch"))


@query("SELECT 7500 AS seconds")
def lease_seconds(spark, sf):
    return spark.range(1).select(F.lit(J.LEASE_SECONDS).alias("seconds"))


# collections and chats
_META = "CASE p_size % 3 WHEN 0 THEN p_name || '__meta__l' || CAST(p_size + 1 AS VARCHAR) WHEN 1 THEN p_name || '__meta' ELSE p_name END"


def _collections(spark, sf) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("__meta__l"), (F.col("p_size") + 1).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("__meta"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("collection_id"), F.col("p_brand").alias("namespace_id"), name.alias("name"))


@query(f"SELECT p_name AS root, {_META} AS name, CASE p_size % 3 WHEN 0 THEN p_size + 1 ELSE 1 END AS level FROM part WHERE p_size % 3 < 2")
def meta_descendants(spark, sf):
    return S.descendants(_collections(spark, sf))


@query(f"SELECT p_partkey AS collection_id, CASE WHEN p_name = 'small ring' THEN 'big ring' || substr({_META}, 11) ELSE {_META} END AS name FROM part")
def cascade_rename(spark, sf):
    return S.renamed(_collections(spark, sf), "small ring", "big ring").select("collection_id", "name")


@query(f"SELECT p_partkey AS collection_id, {_META} AS name FROM part WHERE p_name <> 'small ring'")
def delete_collection(spark, sf):
    return S.deleted(_collections(spark, sf), "small ring").select("collection_id", "name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def reset_collection(spark, sf):
    return S.reset(table(spark, sf, "orders").withColumnRenamed("o_custkey", "collection_id"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("collection_id"))).select("o_orderkey")


@query("SELECT c_custkey AS collection_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'light_rag' ELSE 'custom_graph_rag' END AS strategy, CASE WHEN c_acctbal > 0 THEN 'local' ELSE 'mix' END AS default_query_mode FROM customer")
def create_collection(spark, sf):
    strategy = F.when(F.col("c_acctbal") > 0, "light_rag").otherwise("custom_graph_rag")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("collection_id"), F.col("c_nationkey").alias("namespace_id"), F.col("c_name").alias("name"), strategy.alias("strategy"))
    return S.checked_collections(rows).select(F.col("collection_id").cast("bigint").alias("collection_id"), "name", "strategy", "default_query_mode")


@query("SELECT p_partkey AS collection_id FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def collections_list(spark, sf):
    rows = _collections(spark, sf)
    return L.by_keys(rows, table(spark, sf, "part").where("p_size > 49").select(F.col("p_brand").alias("namespace_id")), "namespace_id").select("collection_id")


@query("SELECT c_custkey AS chat_id, count(turn) AS n_messages, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last_turn FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def chat_sessions(spark, sf):
    """All sessions with their counts; sessions without messages stay."""
    return S.chat_sessions(table(spark, sf, "customer").select(F.col("c_custkey").alias("chat_id")), table(spark, sf, "conversations").withColumnRenamed("conv_id", "chat_id"))


@query("SELECT conv_id AS chat_id, max(turn) + 1 AS next_turn, 2 * max(turn) + 1 AS next_message FROM conversations GROUP BY 1")
def record_exchange(spark, sf):
    return S.next_places(table(spark, sf, "conversations").withColumnRenamed("conv_id", "chat_id").withColumn("message_index", 2 * F.col("turn")))


@query("WITH o AS (SELECT o_custkey AS src, o_orderkey AS dst, 1 AS weight, ['b'] AS keywords FROM orders), n AS (SELECT o_custkey AS src, o_orderkey AS dst, 3 AS weight, ['a', 'b'] AS keywords FROM orders WHERE o_orderstatus = 'F') SELECT o.src, o.dst, greatest(o.weight, n.weight) AS weight, CASE WHEN n.src IS NULL THEN 'b' ELSE 'a|b' END AS keywords FROM o LEFT JOIN n ON n.src = o.src AND n.dst = o.dst")
def merge_chat_edge(spark, sf):
    def of(rows: DataFrame, weight: int, *words: str) -> DataFrame:
        return rows.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit(weight).alias("weight"), F.array(*map(F.lit, words)).alias("keywords"), F.array(F.lit("m")).alias("source_ids"))

    rows = table(spark, sf, "orders")
    return chat.merged_edges(of(rows, 1, "b"), of(rows.where("o_orderstatus = 'F'"), 3, "a", "b")).select("src", "dst", "weight", _joined("keywords").alias("keywords"))


@query("""WITH l AS (SELECT o_custkey AS chat_id, 0 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY 'n' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS n, 'Entity: n' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '. ' || o_orderpriority AS line FROM orders)
SELECT chat_id, array_to_string(list(line ORDER BY n), chr(10)) AS context FROM l WHERE n <= 8 GROUP BY 1""")
def semantic_text(spark, sf):
    rows = table(spark, sf, "orders")
    nodes = rows.select(F.col("o_custkey").alias("chat_id"), F.concat(F.lit("n"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name"), F.col("o_orderpriority").alias("description"))
    return S.semantic_text(nodes, spark.createDataFrame([], "chat_id bigint, source string, target string, description string"))


@query("SELECT conv_id AS chat_id, text AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def rewrite(spark, sf):
    last = A.top_per(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 1)
    return S.rewritten(last.select(F.col("conv_id").alias("chat_id"), F.col("text").alias("question"), F.lit("x").alias("context")))


# prompts and text
@query("SELECT o_custkey AS chunk_id, 'Already extracted:' || chr(10) || 'Entities: ' || array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ', ') || chr(10) || 'Relationships: ' || array_to_string(list(CAST(o_custkey AS VARCHAR) || ' -[PLACED]-> ' || CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ', ') AS known FROM orders GROUP BY 1")
def format_existing(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").cast("string").alias("source"), F.lit("PLACED").alias("rel_type"))
    return prompts.existing(rows, rows.withColumn("target", F.col("name")))


@query("SELECT o_custkey AS chunk_id, 'Entities:' || chr(10) || array_to_string(list('- ' || CAST(o_orderkey AS VARCHAR) || ' [ORDER]: ' || o_orderpriority ORDER BY o_orderkey), chr(10)) || chr(10) || 'Relationships:' || chr(10) || '- (none)' AS graph FROM orders GROUP BY 1")
def format_candidates(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), F.lit("ORDER").alias("entity_type"), F.col("o_orderpriority").alias("description"))
    none = spark.createDataFrame([], "chunk_id bigint, ord bigint, source string, target string, rel_type string, description string, keywords array<string>, weight double")
    return prompts.candidates(rows, none)


@query()
def taxonomy_prompt(spark, sf):
    return spark.createDataFrame([(prompts.taxonomy_rules(), json.dumps(prompts.taxonomy_schema(), sort_keys=True))], "rules string, schema string")


@query("SELECT DISTINCT 'derived:entity:' || replace(lower(p_name), ' ', '_') AS id, p_name AS name FROM part")
def entity_ref(spark, sf):
    return prompts.entity_refs(table(spark, sf, "part").select(F.col("p_name").alias("name")))


@query(f"WITH {V.NAMED_SQL} SELECT source_name || '__' || rel_type || '__' || target_name AS id, min(rel_id) AS first FROM named GROUP BY 1")
def derived_edge(spark, sf):
    return prompts.derived_edges(V.named_relations(spark, sf).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", F.col("rel_id").alias("seq")))


_CAND = f"""{V.ENTITIES_SQL}, {V.ALIASES_SQL}, {INDEX_SQL}, q AS ({QUESTIONS}),
w AS (SELECT question_id, string_split({_key('question')}, ' ') AS w FROM q),
g AS (SELECT DISTINCT question_id, array_to_string(w[i + 1 : i + n], ' ') AS key FROM (SELECT question_id, w, i, unnest(range(1, 5)) AS n FROM (SELECT question_id, w, unnest(range(len(w))) AS i FROM w)) WHERE i + n <= len(w)),
h AS (SELECT question_id, entity_id, name, max(score) AS score FROM g JOIN idx USING (key) GROUP BY ALL),
m AS (SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(name) DESC, entity_id) AS rank FROM h),
l AS (SELECT question_id, list(name ORDER BY rank) AS names FROM m WHERE rank <= 8 GROUP BY 1)"""


@query(f"""WITH {_CAND} SELECT question_id, 0 AS ord, CASE WHEN len(names) = 1 THEN 'How does ' || names[1] || ' relate to the question?' ELSE 'How do ' || array_to_string(names[1 : len(names) // 2], ', ') || ' relate to each other?' END AS subquery FROM l
UNION ALL SELECT question_id, 1, 'How do ' || array_to_string(names[len(names) // 2 + 1 :], ', ') || ' relate to each other?' FROM l WHERE len(names) > 1""")
def mix_subqueries(spark, sf):
    from graphloom.operators import mentions

    found = mentions.find(questions(spark, sf), mentions.index(V.entities(spark, sf), V.entity_aliases(spark, sf)), 8)
    return prompts.subqueries(found.select("question_id", "name", "rank"))


@query(f"WITH {_CAND}, {D.ENTITY_SQL} SELECT h.question_id, document_id, max(score) AS best_score, count(DISTINCT h.name) AS n_entities FROM h JOIN edesc ON edesc.entity_id = h.entity_id GROUP BY 1, 2")
def document_candidates(spark, sf):
    """Documents that describe the mentioned entities of all questions, with their best score."""
    from graphloom.operators import mentions

    found = mentions.find(questions(spark, sf), mentions.index(V.entities(spark, sf), V.entity_aliases(spark, sf)), 1 << 30)
    rows = found.join(D.entity_descriptions(spark, sf).select("entity_id", "document_id"), "entity_id")
    return rows.groupBy("question_id", "document_id").agg(F.max("score").alias("best_score"), F.count_distinct("name").alias("n_entities"))


@query(f"SELECT doc_id, {_dashed('md5(text)')} AS id FROM documents")
def derived_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.dashed(T.md5_parts(F.col("text"))).alias("id"))


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def validate_embedding(spark, sf):
    from graphloom.operators import knn

    return table(spark, sf, "embeddings").select("vec_id", F.size(knn.validated(F.col("embedding"))).alias("n"))


@query("SELECT conv_id, turn, CAST(len(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS n FROM conversations")
def clean_chunks(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(P.clean(F.split("text", r"\."))).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || p_type ELSE p_name || chr(10) || chr(10) || p_type END AS joined FROM part")
def join_units(spark, sf):
    left = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("\n")))
    return table(spark, sf, "part").select("p_partkey", P.joined(left, F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("\n"), "p_type"))).alias("joined"))


@query("SELECT conv_id, turn, '<Instruct>: ' || {i} || chr(10) || '<Query>: Relationship type: RELATES_TO. Source: user-question. Target: graph-answer. Description: ' || text AS value FROM conversations".format(i="'" + T.RELATION_INSTRUCTION.replace("'", "''") + "'"))
def embed_rel_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.relation_query(F.col("text")).alias("value"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS name FROM events")
def parse_endpoint(spark, sf):
    value = F.when(F.col("event_type") == "click", F.lit('{"description": "no name"}')).when(F.col("event_type") == "view", F.lit('"  view "')).otherwise(F.concat(F.lit('{"name": "'), "event_type", F.lit('"}')))
    return table(spark, sf, "events").select("event_id", X.endpoint_name(value).alias("name"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS keywords FROM part")
def parse_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _joined(X.keywords_of(F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", ,")))).alias("keywords"))


@query(f"WITH {V.RELATIONS_SQL} SELECT rel_type, CAST(CASE rel_type WHEN 'PLACED' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM (SELECT DISTINCT rel_type FROM relations)")
def dimension_weight(spark, sf):
    weights = spark.createDataFrame([("PLACED", 0.5)], "rel_type string, weight double")
    return V.relations(spark, sf).select("rel_type").distinct().join(weights, "rel_type", "left").select("rel_type", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"WITH q AS (SELECT label AS rel_type, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1), s AS (SELECT rel_type, round({_cos('embedding', 'v')}, 6) AS sim, row_number() OVER (PARTITION BY rel_type ORDER BY round({_cos('embedding', 'v')}, 6) DESC, vec_id) AS r FROM embeddings, q) SELECT rel_type, round(max(sim) + avg(sim), 6) AS score, max(sim) AS top FROM s WHERE r <= 3 GROUP BY 1")
def score_dimension(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.groupBy(F.col("label").alias("rel_type")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return R.dimension_scores(rows.select(F.col("vec_id").alias("rel_id"), "embedding"), asked)


@query(f"SELECT label AS rel_id, max(round({_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6)) AS sim FROM embeddings GROUP BY 1")
def rel_similarity(spark, sf):
    """The best of all embeddings of each relation."""
    from graphloom.queries.relational import vector

    return table(spark, sf, "embeddings").select(F.col("label").alias("rel_id"), U.similarity(F.col("embedding"), vector(spark, sf)).alias("sim")).groupBy("rel_id").agg(F.max("sim").alias("sim"))
