"""Scans, filters, joins, aggregations, windows, merges, kNN and mentions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as T, udfs as U
from graphloom.operators import aggregates as A, graph as G, knn, mentions
from graphloom.queries.scalar import PUNCT, _words, family_sql
from graphloom.sources import store, tables as V
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


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The embedding of one row, as the vector of a question."""
    found = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(found[0]) if found else [1.0]


def ask(spark: SparkSession, words: str) -> list[float]:
    return U.embed(words).tolist()


_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"


@query(f"SELECT vec_id, label, {_COS} AS score FROM embeddings ORDER BY score DESC NULLS LAST, vec_id LIMIT 5")
def knn_chunks(spark, sf):
    return knn.top(table(spark, sf, "embeddings"), vector(spark, sf), 5, "vec_id").select("vec_id", "label", "score")


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE CAST(label AS VARCHAR) = '3' ORDER BY score DESC NULLS LAST, vec_id LIMIT 5")
def metadata_filter(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("metadata", F.to_json(F.struct("label")))
    return knn.top(rows, vector(spark, sf), 5, "vec_id", knn.metadata_filter(F.col("metadata"), {"label": "3"})).select("vec_id", "score")


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score DESC NULLS LAST, vec_id LIMIT 50")
def knn_entities(spark, sf):
    return knn.top(table(spark, sf, "embeddings"), vector(spark, sf), 50, "vec_id", knn.in_list(F.col("label"), [1, 2, 3])).select("vec_id", "score")


@query("SELECT vec_id AS query_id, vec_id, CAST(1.0 AS DOUBLE) AS score, 1 AS rank FROM embeddings")
def knn_self(spark, sf):
    rows = table(spark, sf, "embeddings")
    return knn.batch_top(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 1)


@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL),
m AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label)
SELECT e.vec_id AS query_id, label, score, rank FROM (SELECT e.vec_id, m.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v), 6) AS score, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v), 6) DESC, m.label) AS rank FROM embeddings e, m) e WHERE rank <= 3""")
def knn_centroids(spark, sf):
    """The three nearest label centroids of every vector."""
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))
    # centroids are as few as labels, vectors are many: roles turn, and each vector keeps its best three
    near = centroids.crossJoin(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")))
    scored = near.select("query_id", "label", F.round(U.cosine_expression(F.col("v"), F.col("embedding")), 6).alias("score"))
    return A.top_per(scored, ["query_id"], [F.desc("score"), F.col("label")], 3)


QUESTIONS = "SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS question_id, 'What does supplier ' || CAST(s_suppkey AS VARCHAR) || ' deliver to ' || n_name || '?' AS question FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _key(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '{PUNCT}', ' ', 'g'), '\\s+', ' ', 'g'))"


INDEX_SQL = f"""canon AS (SELECT {_key('name')} AS key, max(id) AS entity_id, arg_max(name, id) AS name, CAST(1.0 AS DOUBLE) AS score FROM entities WHERE length(name) >= 3 GROUP BY 1),
other AS (SELECT {_key('alias_name')} AS key, min(entity_id) AS entity_id, arg_min(name, entity_id) AS name, CAST(0.98 AS DOUBLE) AS score FROM aliases JOIN entities ON id = entity_id
  WHERE length(alias_name) >= 3 AND {_key('alias_name')} NOT IN (SELECT key FROM canon) GROUP BY 1),
idx AS (SELECT * FROM canon UNION ALL SELECT * FROM other)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    return rows.select(F.concat(F.lit("supplier:"), key).alias("question_id"), F.concat(F.lit("What does supplier "), key, F.lit(" deliver to "), "n_name", F.lit("?")).alias("question"))


@query(f"WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL}, {INDEX_SQL} SELECT * FROM idx WHERE key <> ''")
def mention_index(spark, sf):
    return mentions.index(V.entities(spark, sf), V.entity_aliases(spark, sf))


@query(f"""WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL}, {INDEX_SQL}, q AS ({QUESTIONS}),
w AS (SELECT question_id, string_split({_key('question')}, ' ') AS w FROM q),
g AS (SELECT DISTINCT question_id, array_to_string(w[i + 1 : i + n], ' ') AS key FROM (SELECT question_id, w, i, unnest(range(1, 5)) AS n FROM (SELECT question_id, w, unnest(range(len(w))) AS i FROM w)) WHERE i + n <= len(w)),
h AS (SELECT question_id, entity_id, name, max(score) AS score FROM g JOIN idx USING (key) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(name) DESC, entity_id) AS rank FROM h) WHERE rank <= 20""")
def find_mentions(spark, sf):
    return mentions.find(questions(spark, sf), mentions.index(V.entities(spark, sf), V.entity_aliases(spark, sf)))


@query("SELECT turn, conv_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(w1, w2), list_concat(w3, w4)))), '|') AS grams FROM (SELECT conv_id, turn, w AS w1, list_transform(range(len(w) - 1), lambda i: array_to_string(w[i + 1 : i + 2], ' ')) AS w2, list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')) AS w3, list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) AS w4 FROM (SELECT conv_id, turn, list_filter(string_split(" + _key("text") + ", ' '), lambda x: x <> '') AS w FROM conversations))")
def question_ngrams(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(T.ngrams(T.mention_key(F.lower("text"))))), "|").alias("grams"))


@query(f"WITH {V.NAMED_SQL} SELECT rel_id, source_name, target_name, rel_type, weight FROM named")
def load_graph_records(spark, sf):
    return V.named_relations(spark, sf).select("rel_id", "source_name", "target_name", "rel_type", "weight")


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL}, s AS (SELECT src AS node, dst AS neighbour, rel_type, rel_id FROM relations UNION ALL SELECT dst, src, rel_type, rel_id FROM relations) SELECT s.* FROM s JOIN entities ON id = node WHERE primary_type = 'NATION'")
def neighbours(spark, sf):
    nodes = V.entities(spark, sf).where("primary_type = 'NATION'").select(F.col("id").alias("node"))
    return G.neighbours(V.relations(spark, sf), nodes)


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL}, s AS (SELECT src AS node, dst AS neighbour, rel_type, rel_id FROM relations UNION ALL SELECT dst, src, rel_type, rel_id FROM relations) SELECT s.* FROM s JOIN entities ON id = node WHERE primary_type = 'CUSTOMER' AND rel_type IN ('PLACED')")
def neighbours_typed(spark, sf):
    nodes = V.entities(spark, sf).where("primary_type = 'CUSTOMER'").select(F.col("id").alias("node"))
    return G.neighbours(V.relations(spark, sf), nodes, ["PLACED", None])


@query(f"WITH {V.RELATIONS_SQL} SELECT src, dst, min(rel_id) AS rel_id FROM relations GROUP BY src, dst")
def get_edge(spark, sf):
    edges = V.relations(spark, sf)
    return G.get_edge(edges, edges).select("src", "dst", "rel_id")


@query(f"""WITH RECURSIVE {V.RELATIONS_SQL}, s AS (SELECT src AS a, dst AS b FROM relations UNION SELECT dst, src FROM relations),
r AS (SELECT 'region:0' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN s ON a = node WHERE hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def ego_graph(spark, sf):
    return G.ego(V.relations(spark, sf), "region:0", 3)


@query(f"WITH {V.ENTITIES_SQL}, {V.ALIASES_SQL} SELECT id, name FROM entities WHERE contains(lower(name), 'ring') OR id IN (SELECT entity_id FROM aliases WHERE contains(lower(alias_name), 'ring')) ORDER BY id LIMIT 10")
def name_contains(spark, sf):
    return G.name_contains(V.entities(spark, sf), V.entity_aliases(spark, sf), "RING")


@query(f"WITH {V.RELATIONS_SQL} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM relations UNION ALL SELECT dst, 0, 1 FROM relations) GROUP BY node")
def node_degrees(spark, sf):
    return G.node_degrees(V.relations(spark, sf))


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL}, n AS (SELECT id FROM entities WHERE primary_type IN ('NATION', 'REGION', 'SUPPLIER')) SELECT rel_id FROM relations WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n)")
def edges_touching(spark, sf):
    nodes = V.entities(spark, sf).where(F.col("primary_type").isin("NATION", "REGION", "SUPPLIER")).select(F.col("id").alias("node"))
    return G.touching(V.relations(spark, sf), nodes).select("rel_id")


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL}, n AS (SELECT id FROM entities WHERE primary_type IN ('NATION', 'CUSTOMER')) SELECT rel_id FROM relations WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edges_inside(spark, sf):
    nodes = V.entities(spark, sf).where(F.col("primary_type").isin("NATION", "CUSTOMER")).select(F.col("id").alias("node"))
    return G.inside(V.relations(spark, sf), nodes).select("rel_id")


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL} SELECT id FROM entities WHERE id NOT IN (SELECT src FROM relations UNION SELECT dst FROM relations)")
def isolated_nodes(spark, sf):
    return G.isolated(V.entities(spark, sf), V.relations(spark, sf)).select("id")


@query("SELECT sha256(text) AS chunk_hash, min(doc_id) AS document_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY 1")
def upsert_chunks(spark, sf):
    chunks = V.chunks(spark, sf)
    return store.insert_absent(chunks.where("source = 'src0'"), chunks, ["chunk_hash", "chunk_index"], "document_id").select("chunk_hash", "document_id")


@query("SELECT c_custkey, coalesce(n.s, c_mktsegment) AS c_mktsegment, coalesce(n.b, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS s, round(sum(o_totalprice), 2) AS b FROM orders GROUP BY 1) n ON k = c_custkey")
def upsert_centroid(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"), F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    return store.upsert(old, new, ["c_custkey"])


_NEW = "SELECT src, dst, 'CONTAINS' AS rel_type, 7 AS weight, list_append(keywords, 'Small') AS keywords FROM relations WHERE rel_type = 'CONTAINS' AND weight > 1 UNION ALL SELECT src, 'region:0', 'NEAR', 1, ['x', 'X'] FROM relations WHERE rel_type = 'LOCATED_IN'"
_KW = "list_filter(coalesce(r.keywords, []) || coalesce(n.keywords, []), lambda k, i: list_position(list_transform(coalesce(r.keywords, []) || coalesce(n.keywords, []), lambda x: lower(x)), lower(k)) = i)"


@query(f"WITH {V.RELATIONS_SQL}, n AS ({_NEW}) SELECT coalesce(r.src, n.src) AS src, coalesce(r.dst, n.dst) AS dst, coalesce(r.rel_type, n.rel_type) AS rel_type, coalesce(n.weight, r.weight) AS weight, array_to_string({_KW}, ',') AS keywords FROM relations r FULL JOIN n ON r.src = n.src AND r.dst = n.dst AND r.rel_type = n.rel_type")
def upsert_edges(spark, sf):
    edges = V.relations(spark, sf)
    more = edges.where("rel_type = 'CONTAINS' AND weight > 1").select("rel_id", "src", "dst", "rel_type", F.lit(7).alias("weight"), F.array_append("keywords", F.lit("Small")).alias("keywords"))
    near = edges.where("rel_type = 'LOCATED_IN'").select(F.concat(F.lit("NEAR:"), "src").alias("rel_id"), "src", F.lit("region:0").alias("dst"), F.lit("NEAR").alias("rel_type"), F.lit(1).alias("weight"), F.array(F.lit("x"), F.lit("X")).alias("keywords"))
    return store.upsert_edges(edges, more.unionByName(near)).select("src", "dst", "rel_type", "weight", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS keywords FROM (SELECT p_partkey, list_filter(w, lambda k, i: list_position(list_transform(w, lambda x: lower(x)), lower(k)) = i) AS list_distinct_ordered FROM (SELECT p_partkey, string_split(p_name, ' ') || [p_type, lower(p_type), upper(p_brand)] AS w FROM part))")
def merge_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(store.merged_keywords(F.split("p_name", " "), F.array("p_type", F.lower("p_type"), F.upper("p_brand"))), ",").alias("keywords"))


@query(f"WITH {V.RELATIONS_SQL} SELECT rel_type || ':' || src || ':' || dst AS rel_id, weight FROM (SELECT src, dst, CASE rel_type WHEN 'SUPPLIES' THEN 'CONTAINS' ELSE rel_type END AS rel_type, CAST(least(sum(weight), 100) AS INTEGER) AS weight FROM relations GROUP BY ALL)")
def relabel_edges(spark, sf):
    return store.relabel(V.relations(spark, sf), "SUPPLIES", "CONTAINS").select("rel_id", "weight")


@query("SELECT event_id FROM events WHERE NOT coalesce(json_extract_string(props, '$.k') = '3', false)")
def delete_by_metadata(spark, sf):
    return store.delete_where(table(spark, sf, "events"), knn.metadata_filter(F.col("props"), {"k": "3"})).select("event_id")


@query(f"WITH {V.ENTITIES_SQL}, {V.RELATIONS_SQL} SELECT rel_id FROM relations WHERE src NOT LIKE 'orders:%' AND dst NOT LIKE 'orders:%'")
def delete_collection_nodes(spark, sf):
    return store.delete_nodes(V.entities(spark, sf), V.relations(spark, sf), F.col("primary_type") == "ORDERS")[1].select("rel_id")


_RT = "CASE WHEN rel_type = 'CONTAINS' AND weight > 1 THEN 'HAS_ITEM' WHEN rel_type = 'PLACED' THEN 'ORDERED' ELSE rel_type END"


@query(f"WITH {V.RELATIONS_SQL}, a(alias_type, canonical_type) AS (VALUES {', '.join(str(x) for x in V.ALIASES.items())}) SELECT rel_id, coalesce(canonical_type, t) AS canonical_type FROM (SELECT rel_id, {_RT} AS t FROM relations) LEFT JOIN a ON alias_type = t")
def canonical_type(spark, sf):
    return A.canonical_types(V.relations(spark, sf).withColumn("rel_type", F.expr(_RT)), V.relation_aliases(spark)).select("rel_id", "canonical_type")


@query(f"WITH {V.RELATIONS_SQL}, t AS (SELECT src AS query_id, rel_type, weight / 100.0 AS combined FROM relations), s AS (SELECT query_id, round(coalesce(sum(combined) FILTER (rel_type IN {A.ROUTES['hub']}), 0), 6) AS hub, round(coalesce(sum(combined) FILTER (rel_type IN {A.ROUTES['authority']}), 0), 6) AS authority, round(coalesce(sum(combined) FILTER (rel_type IN {A.ROUTES['bridge']}), 0), 6) AS bridge, round(coalesce(sum(combined) FILTER (rel_type IN {A.ROUTES['central']}), 0) + 1.0, 6) AS central, round(coalesce(sum(combined) FILTER (rel_type IN {A.ROUTES['importance']}), 0) * 0.5 + 0.8, 6) AS importance FROM t GROUP BY 1) SELECT *, CASE greatest(hub, authority, bridge, central, importance) WHEN hub THEN 'hub' WHEN authority THEN 'authority' WHEN bridge THEN 'bridge' WHEN central THEN 'central' ELSE 'importance' END AS primary_route FROM s")
def route_profile(spark, sf):
    rows = A.canonical_types(V.relations(spark, sf), V.relation_aliases(spark))
    return A.route_profile(rows.select(F.col("src").alias("query_id"), "canonical_type", (F.col("weight") / 100.0).alias("combined")))


@query("SELECT 'q' || CAST(o_custkey % 7 AS VARCHAR) AS query_id, 'e' || CAST(o_orderkey % 101 AS VARCHAR) AS entity_id, max(CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0.25 END + o_orderkey % 10 / 100.0) AS relevance FROM orders GROUP BY 1, 2")
def merge_entity_states(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("q"), F.col("o_custkey") % 7).alias("query_id"), F.concat(F.lit("e"), F.col("o_orderkey") % 101).alias("entity_id"), (F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.25) + F.col("o_orderkey") % 10 / 100.0).alias("relevance"), "o_orderstatus")
    split = [rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F' or o_orderstatus is null")]
    return A.merge_entity_states([s.drop("o_orderstatus") for s in split])


@query("""WITH s AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS query_id, CAST(o_orderkey % 101 AS VARCHAR) AS rel_id, o_orderkey % 13 / 13.0 AS combined, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS state FROM orders),
m AS (SELECT query_id, rel_id, arg_max(combined, (state, ord)) AS combined, min((state, ord)) AS first FROM s GROUP BY 1, 2)
SELECT query_id, rel_id, combined, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, first) AS ord FROM m""")
def merge_states(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 7).cast("string").alias("query_id"), (F.col("o_orderkey") % 101).cast("string").alias("rel_id"), (F.col("o_orderkey") % 13 / 13.0).alias("combined"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("f"))
    return A.merge_relation_states([rows.where("f").drop("f"), rows.where("not f").drop("f")])


@query("SELECT o_orderkey, CASE WHEN max(o_totalprice) OVER (PARTITION BY o_custkey) > 0 THEN round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 9) ELSE 0 END AS share FROM orders")
def max_normalise(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(A.max_normalised("o_totalprice", ["o_custkey"]), 9).alias("share"))


_FAM = family_sql("rel_type", "lower(source_name || ' ' || target_name)")
FAMILIES_SQL = f"{V.NAMED_SQL}, fam AS (SELECT *, {_FAM} AS family FROM named), inc AS (SELECT src AS node, family, rel_type, 'out' AS direction FROM fam UNION ALL SELECT dst, family, rel_type, 'in' FROM fam)"
_ORD = "list_position([" + ", ".join(f"'{f}'" for f in T.FAMILY_ORDER) + "], family)"


@query(f"WITH {FAMILIES_SQL}, c AS (SELECT node, family, count(*) AS n FROM inc GROUP BY ALL) SELECT node, family FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY family = 'generic_other', n DESC, {_ORD}) AS r FROM c) WHERE r = 1")
def argmax_family(spark, sf):
    rows = V.named_relations(spark, sf).withColumn("family", T.edge_family(F.col("rel_type"), F.col("source_name"), F.col("target_name")))
    return A.primary_family(G.symmetric(rows, "family").groupBy("node", "family").agg(F.count("*").alias("n")), "node")


@query(f"WITH {V.RELATIONS_SQL}, d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM relations UNION ALL SELECT dst, 0, 1 FROM relations) GROUP BY node) SELECT node, CASE WHEN o + i = 0 THEN 'isolated' WHEN o >= 2 * i THEN 'source' WHEN i >= 2 * o THEN 'sink' ELSE 'bridge' END AS role FROM d")
def direction_role(spark, sf):
    return G.node_degrees(V.relations(spark, sf)).select("node", T.direction_role(F.col("out_degree"), F.col("in_degree")).alias("role"))


@query("SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS frequency FROM (SELECT user_id, event_type, 1 AS n FROM events UNION ALL SELECT DISTINCT user_id, 'click', 5 FROM events) GROUP BY ALL")
def type_frequency(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type")
    old = rows.select("user_id").distinct().withColumns({"event_type": F.lit("click"), "frequency": F.lit(5).cast("bigint")})
    return A.counted_types(old, rows, ["user_id", "event_type"])


@query("SELECT type_id, arg_min(a, (-n, a)) AS canonical_type FROM (SELECT user_id % 10 AS type_id, event_type AS a, count(*) AS n FROM events GROUP BY ALL) GROUP BY type_id")
def reelect_canonical(spark, sf):
    rows = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("type_id"), F.col("event_type").alias("alias_type")).agg(F.count("*").alias("frequency"))
    return A.elected(rows)


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 20")
def chat_sessions_summary(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count("*").alias("n"), F.max("turn").alias("last_turn"))
    return rows.orderBy(F.desc("last_turn"), "conv_id").limit(20)


@query("SELECT conv_id, max(turn) + 1 AS next_turn, 2 * count(*) + 1 AS next_message FROM conversations GROUP BY conv_id")
def next_turn(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), (2 * F.count("*") + 1).alias("next_message"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def recent_messages(spark, sf):
    return A.recent(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20")
def list_jobs(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(20)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def count_active(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, count(*) FILTER (event_type = 'purchase') AS done, CAST(least(100, floor(100.0 * count(*) FILTER (event_type IN ('purchase', 'error')) / count(*))) AS INTEGER) AS percent, CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) < count(*) THEN 'processing' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id")
def job_progress(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("state"))
    return A.job_progress(rows, rows.groupBy("job_id").agg(F.count("*").alias("n_chunks")))


_TOK = f"greatest(1, len({_words('text')}))"


@query(f"""WITH t AS (SELECT conv_id, turn, text, {_TOK} AS tokens, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
SELECT conv_id, turn, tokens, upto <= 60 AS whole, CASE WHEN upto <= 60 THEN text ELSE substr(text, 1, CAST(60 - upto + tokens AS INTEGER) * 4) || '...' END AS shown FROM t WHERE upto <= 60 OR (upto - tokens <= 60 AND 60 - upto + tokens > 10)""")
def budget_context(spark, sf):
    return A.budgeted(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], "text", 60).select("conv_id", "turn", "tokens", "whole", "shown")


@query(f"WITH {V.RELATIONS_SQL} SELECT src, rel_id, rank FROM (SELECT src, rel_id, row_number() OVER (PARTITION BY src ORDER BY weight DESC, rel_id) AS rank FROM relations) WHERE rank <= 4")
def top_descriptions(spark, sf):
    return A.top_per(V.relations(spark, sf), ["src"], [F.desc("weight"), F.col("rel_id")], 4).select("src", "rel_id", "rank")


@query(f"WITH {V.RELATIONS_SQL} SELECT src, rel_type, rel_id FROM (SELECT *, row_number() OVER (PARTITION BY src, rel_type ORDER BY weight DESC, rel_id) AS r FROM relations) WHERE r = 1")
def best_edge_per_type(spark, sf):
    return A.top_per(V.relations(spark, sf), ["src", "rel_type"], [F.desc("weight"), F.col("rel_id")], 1).select("src", "rel_type", "rel_id")
