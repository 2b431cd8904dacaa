"""Traversals, query modes, analytics, text preparation, extraction, resolution, jobs and chat over whole tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as T
from graphloom.operators import analytics as N, chat, extract as X, jobs as J, prepare as P, resolve, traverse
from graphloom.plans import modes
from graphloom.queries.relational import FAMILIES_SQL
from graphloom.queries.scalar import _words
from graphloom.sources import tables as V
from graphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "What does supplier 3 deliver to NATION_4 with small ring?"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _engine(spark: SparkSession, sf: str) -> modes.Engine:
    return modes.Engine.over(spark, sf)


def _mode(name: str, run: Callable[[modes.Engine], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: run(_engine(spark, sf))


_mode("q_vector", lambda e: e.vector_query(QUESTION))
_mode("q_naive", lambda e: e.light_query(QUESTION, "naive"))
_mode("q_local", lambda e: e.light_query(QUESTION, "local"))
_mode("q_global", lambda e: e.light_query(QUESTION, "global"))
_mode("q_hybrid", lambda e: e.light_query(QUESTION, "hybrid"))
_mode("q_lr_mix", lambda e: e.light_query(QUESTION, "mix"))
_mode("q_graph_rag", lambda e: e.graph_query(QUESTION))
_mode("graph_hybrid", lambda e: e.graph_query(QUESTION, "hybrid"))
_mode("entity_first", lambda e: e.state(QUESTION, "entity")[0])
_mode("relationship_first", lambda e: e.state(QUESTION, "rel")[1])
_mode("anchor_state", lambda e: e.merged(e.anchors(QUESTION))[1])
_mode("entity_candidates", lambda e: e.candidates(QUESTION))
_mode("build_context", lambda e: e.context(*e.state(QUESTION, "entity")))
_mode("rel_seeds", lambda e: e.relation_seeds(e.scored(QUESTION)).select("rel_id", "sim", "combined"))


@query()
def beam_path(spark, sf):
    """From the source of the question's first relation to what its best neighbour's best neighbour is."""
    scored = _engine(spark, sf).scored(QUESTION)
    start = scored.orderBy(F.desc("sim"), "rel_id").first().src
    near = traverse.Neighbourhoods(scored)
    near.fetch([start])
    middle = near[start][0][1]
    near.fetch([middle])
    target = next(e[1] for e in near[middle] if e[1] != start)
    nodes, rels, _ = traverse.beam_path(near, start, target) or ([], [], {})
    return spark.createDataFrame([(i, n, ([*rels, None])[i]) for i, n in enumerate(nodes)], "ord int, node string, rel_id string")


@query()
def paths_between_sets(spark, sf):
    found = traverse.paths_between(V.relations(spark, sf), ["customer:0", "customer:1", "supplier:0"], ["region:0", "region:1", "part:0"])
    return spark.createDataFrame([(r["start"], r["end"], "|".join(r["nodes"]), r["hop_count"], r["path_score"]) for r in found], "start string, end string, nodes string, hop_count int, path_score double")


_STEPS = {"containment_to_place": (("compositional",), ("location_path", "compositional", "generic_other")), "generic_to_composition": (("generic_other", "location_path"), ("compositional",))}


def _steps_sql(which: int) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS template, source_name, target_name, rel_type, CAST(weight AS DOUBLE) AS weight, family FROM fam WHERE family IN ({', '.join(repr(f) for f in s[which])})" for t, s in _STEPS.items())


@query(f"""WITH {FAMILIES_SQL},
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template, source_name ORDER BY weight DESC, family, target_name, rel_type) AS n FROM ({_steps_sql(0)})) WHERE n <= 12),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template, source_name ORDER BY weight DESC, family, target_name, rel_type) AS n FROM ({_steps_sql(1)})) WHERE n <= 8),
f AS (SELECT DISTINCT a.source_name AS start, a.template, a.target_name AS middle, b.target_name AS "end", a.rel_type AS r1, b.rel_type AS r2, round(a.weight + b.weight, 3) AS score FROM a JOIN b ON a.template = b.template AND a.target_name = b.source_name WHERE a.source_name LIKE 'Customer%')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, template, middle, "end", r1, r2) AS rank FROM f) WHERE rank <= 3""")
def template_paths(spark, sf):
    """Two-step paths of every customer."""
    return traverse.template_paths(V.named_relations(spark, sf), table(spark, sf, "customer").select(F.col("c_name").alias("start")), _STEPS)


_PAIRS = f"""WITH {V.RELATIONS_SQL}, tok AS (SELECT DISTINCT src AS n, 'out|' || dst AS token FROM relations UNION SELECT DISTINCT dst, 'in|' || src FROM relations), sz AS (SELECT n, count(*) AS size FROM tok GROUP BY n),
p AS (SELECT x.n AS a, y.n AS b, count(*) AS overlap FROM tok x JOIN tok y ON x.token = y.token AND x.n < y.n GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT a, b, overlap, s.size AS size_a, t.size AS size_b FROM p JOIN sz s ON s.n = a JOIN sz t ON t.n = b)
SELECT a, b, overlap, round(overlap / sqrt(size_a * size_b), 6) AS cosine, round(overlap / (size_a + size_b - overlap), 6) AS jaccard, size_a, size_b FROM m WHERE overlap / sqrt(size_a * size_b) >= 0.2 AND overlap / (size_a + size_b - overlap) >= 0.1"""


@query(_PAIRS)
def role_pairs(spark, sf):
    return N.role_pairs(V.relations(spark, sf))


@query()
def enumerate_cliques(spark, sf):
    """Maximal cliques of all nodes with like neighbourhoods, by the thresholds of role_pairs; signatures are untyped."""
    pairs = N.role_pairs(V.relations(spark, sf)).select("a", "b", "cosine", "jaccard", "overlap")
    return N.cliques(pairs).select(F.array_join("members", "|").alias("members"), "size", "avg_cosine", "avg_jaccard", "total_overlap")


@query(f"""WITH {FAMILIES_SQL}, c AS (SELECT node, family, count(*) AS n FROM inc GROUP BY ALL),
pf AS (SELECT node, family FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY family = 'generic_other', n DESC, list_position([{', '.join(repr(f) for f in T.FAMILY_ORDER)}], family)) AS r FROM c) WHERE r = 1),
d AS (SELECT node, count(*) FILTER (direction = 'out') AS o, count(*) FILTER (direction = 'in') AS i FROM inc GROUP BY node),
n AS (SELECT d.node, name, family, o + i AS degree, CASE WHEN o >= 2 * i THEN 'source' WHEN i >= 2 * o THEN 'sink' ELSE 'bridge' END AS direction_role FROM d JOIN pf ON d.node = pf.node JOIN entities ON id = d.node),
p AS (SELECT family, direction_role, count(*) AS node_count, CAST(sum(degree) AS BIGINT) AS total_degree FROM n GROUP BY ALL HAVING count(*) >= 5),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, direction_role ORDER BY degree DESC, name, node) AS r FROM n) WHERE r = 1)
SELECT p.family || '_' || p.direction_role AS role_id, node_count, total_degree, a.node AS anchor_id, degree FROM p JOIN a ON p.family = a.family AND p.direction_role = a.direction_role ORDER BY p.family = 'generic_other', node_count DESC, total_degree DESC, role_id LIMIT 100""")
def anchor_regions(spark, sf):
    rows = N.anchor_regions(V.named_relations(spark, sf), V.entities(spark, sf))
    return rows.select("role_id", "node_count", "total_degree", "anchor_id", "degree")


_CONCEPT = "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS node, c_mktsegment AS concept FROM customer UNION ALL SELECT 'orders:' || CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), p_type FROM part UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'NATION' FROM nation"


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    def of(name: str, kind: str, key: str, c) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node"), c.alias("concept"))

    return of("customer", "customer", "c_custkey", F.col("c_mktsegment")).unionByName(of("orders", "orders", "o_orderkey", F.col("o_orderpriority"))).unionByName(of("part", "part", "p_partkey", F.col("p_type"))).unionByName(of("nation", "nation", "n_nationkey", F.lit("NATION")))


@query(f"WITH {V.RELATIONS_SQL}, m AS ({_CONCEPT}) SELECT x.concept AS c1, y.concept AS c2, count(*) AS direct_count, CAST(sum(weight) AS DOUBLE) AS direct_weight, count(DISTINCT rel_type) AS n_types FROM relations JOIN m x ON x.node = src JOIN m y ON y.node = dst WHERE x.concept <> y.concept GROUP BY ALL HAVING count(*) >= 2 OR sum(weight) >= 3 OR count(DISTINCT rel_type) >= 2 ORDER BY direct_weight DESC, direct_count DESC, c1, c2 LIMIT 64")
def concept_pair_agg(spark, sf):
    return N.concept_links(concepts(spark, sf), V.relations(spark, sf))


@query(f"WITH {V.RELATIONS_SQL}, m AS ({_CONCEPT}) SELECT x.concept AS c1, y.concept AS c2, count(*) AS forward, count(DISTINCT src) AS boundary_src, count(DISTINCT dst) AS boundary_dst FROM relations JOIN m x ON x.node = src JOIN m y ON y.node = dst WHERE x.concept <> y.concept GROUP BY ALL")
def cross_cluster_edges(spark, sf):
    return N.cross_edges(concepts(spark, sf).withColumnRenamed("concept", "cluster"), V.relations(spark, sf))


@query()
def pagerank(spark, sf):
    return N.pagerank(V.relations(spark, sf))


@query()
def hits(spark, sf):
    return N.hits(V.relations(spark, sf))


@query()
def eigenvector(spark, sf):
    return N.eigenvector(V.relations(spark, sf))


@query()
def betweenness(spark, sf):
    return N.betweenness(V.relations(spark, sf))


@query()
def harmonic(spark, sf):
    return N.harmonic(V.relations(spark, sf))


@query()
def articulation(spark, sf):
    return N.articulation(V.relations(spark, sf))


_CLEAN = "substr(regexp_replace(nfc_normalize(text), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}]', '', 'g'), 1, 16000)"
_COUNT = " + ".join(f"len(regexp_extract_all(c, '{p}'))" for p in T.INJECTIONS)


@query(f"SELECT doc_id, sha256(c) AS clean, n_ > 16000 AS size_clipped, {_COUNT} AS patterns, CASE WHEN {_COUNT} = 0 THEN 'none' WHEN {_COUNT} <= 2 THEN 'low' WHEN {_COUNT} <= 5 THEN 'medium' ELSE 'high' END AS severity FROM (SELECT doc_id, {_CLEAN} AS c, length(regexp_replace(nfc_normalize(text), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}\\x{{2060}}]', '', 'g')) AS n_ FROM documents)")
def sanitize(spark, sf):
    return P.sanitized(table(spark, sf, "documents")).select("doc_id", F.sha2("clean", 256).alias("clean"), "size_clipped", "patterns", "severity")


@query()
def chunk_text(spark, sf):
    return P.chunked(table(spark, sf, "documents")).select("doc_id", "chunk_index", "chunk_hash", F.length("content").alias("n_chars"))


@query()
def chunk_code(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return P.chunked(pages, 128, code=True).select("doc_id", "chunk_index", "chunk_hash")


@query()
def infer_language(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.code_language(F.col("html")).alias("language"))


@query(f"SELECT doc_id, greatest(1, len({_words('text')})) AS tokens FROM documents")
def token_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.size(T.words(F.col("text")))).alias("tokens"))


def _reader(content: str, known: list) -> str:
    """A stand-in for a model: each pair of neighbouring capitalised words is related; a second pass adds the next pairs."""
    names = list(dict.fromkeys(re.findall(r"\b[A-ZÀ-Þ][\w]{2,}", content)))
    step = 2 if known else 1
    return json.dumps({"relationships": [{"source": {"name": a, "description": f"{a} in text"}, "target": b, "description": f"{a} {b}", "rel_type": ["near", "follows"], "weight": 0.5} for a, b in zip(names, names[step:], strict=False)]})


def triples(spark: SparkSession, sf: str) -> DataFrame:
    return X.extracted(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content")), _reader)


@query()
def extract_with_gleaning(spark, sf):
    return triples(spark, sf).select("chunk_id", "pass", "ord", "source", "target", "rel_type")


@query()
def merge_relationships(spark, sf):
    return X.merged_relations(triples(spark, sf)).select("chunk_id", "ord", "source", "target", "rel_type", "weight")


@query()
def merge_entities(spark, sf):
    return X.merged_entities(triples(spark, sf))


@query()
def resolve_relationship(spark, sf):
    return X.resolved_relations(triples(spark, sf)).drop("keywords")


@query()
def resolve_entity(spark, sf):
    """Customers and parts as mentions, a collection per nation or brand."""
    people = table(spark, sf, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("collection_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.lit("person").alias("entity_type"), F.col("c_mktsegment").alias("description"))
    things = table(spark, sf, "part").select(F.col("p_brand").alias("collection_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.lit("object").alias("entity_type"), F.col("p_type").alias("description"))
    return resolve.resolved(people.unionByName(things))


@query("SELECT key, CAST(arg_min(p_partkey, (p_partkey, CAST(p_partkey AS VARCHAR))) AS VARCHAR) AS entity_id FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS key FROM part) GROUP BY key")
def name_cache(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_partkey").alias("seq"))
    return resolve.first_writers(rows)


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END"
_LEASE = "CASE WHEN event_type = 'click' THEN ts + INTERVAL 7500 SECOND END"
NOW = "2024-01-05 00:00:00"


def job_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks of jobs, one job per user."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    lease = F.when(F.col("event_type") == "click", F.col("ts") + F.make_dt_interval(secs=F.lit(7500)))
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("chunk_index"), status.alias("status"), lease.alias("lease_expires_at"))


_CHUNKS = f"SELECT user_id AS job_id, event_id AS chunk_index, {_STATUS} AS status, {_LEASE} AS lease_expires_at FROM events"


@query(f"WITH c AS ({_CHUNKS}), r AS (SELECT *, count(*) FILTER (status = 'processing') OVER (PARTITION BY job_id) AS active, row_number() OVER (PARTITION BY job_id, status ORDER BY chunk_index) AS turn FROM c) SELECT job_id, chunk_index, CASE WHEN status = 'pending' AND turn <= 25 - active THEN 'processing' ELSE status END AS status FROM r")
def dispatch(spark, sf):
    return J.dispatched(job_chunks(spark, sf), 25, NOW).select("job_id", "chunk_index", "status")


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, chunk_index, CASE WHEN status = 'processing' AND lease_expires_at <= TIMESTAMP '{NOW}' AND job_id % 5 <> 0 THEN 'pending' ELSE status END AS status FROM c")
def reclaim(spark, sf):
    gone = table(spark, sf, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("job_id"))
    return J.reclaimed(job_chunks(spark, sf), NOW, gone).select("job_id", "chunk_index", "status")


@query(f"WITH c AS ({_CHUNKS}) SELECT job_id, chunk_index, CASE WHEN status IN ('pending', 'processing') AND job_id % 5 = 0 THEN 'cancelled' ELSE status END AS status FROM c")
def cancel_chunks(spark, sf):
    gone = table(spark, sf, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("job_id"))
    return J.cancelled(job_chunks(spark, sf), gone).select("job_id", "chunk_index", "status")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def chunk_status(spark, sf):
    return J.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)")
def purge_queue(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"))
    gone = table(spark, sf, "events").where("event_type = 'error' and value > 20").select(F.col("user_id").alias("job_id"))
    return J.purged(rows, gone).select("event_id", F.col("job_id").alias("user_id"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Tumbling windows over the event log: the batch form of the streaming operator."""
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, array_to_string(list(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (turn ' || CAST(turn AS VARCHAR) || '):' || chr(10) || text ORDER BY turn), chr(10) || chr(10)) AS context FROM r WHERE back <= 6 GROUP BY conv_id""")
def chat_transcript(spark, sf):
    return chat.transcript(table(spark, sf, "conversations"))


@query()
def chat_context(spark, sf):
    rows = table(spark, sf, "conversations")
    asked = rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return chat.context_turns(rows, asked)


@query("""WITH o AS (SELECT o_custkey AS node_id, max(o_orderpriority) AS d, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, node_id) AS node_id, CASE WHEN d IS NOT NULL AND length(d) >= coalesce(length(c_mktsegment), 0) THEN d ELSE c_mktsegment END AS description,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c_custkey IS NULL THEN [] ELSE ['F', 'x'] END, coalesce(s, [])))), ',') AS source_ids FROM customer FULL JOIN o ON c_custkey = node_id""")
def merge_chat_node(spark, sf):
    two = F.array(F.lit("F"), F.lit("x"))
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("description"), two.alias("source_ids"), two.alias("roles"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.max("o_orderpriority").alias("description"), F.collect_set("o_orderstatus").alias("source_ids"), F.collect_set("o_orderstatus").alias("roles"))
    return chat.merged_nodes(old, new).select("node_id", "description", F.array_join("source_ids", ",").alias("source_ids"))
