"""One query for each scalar function, over whole columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import text as T, udfs as U
from graphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PUNCT = "[!-/:-@\\[-`{-~]"
COLLECTION = "00000000-0000-4000-8000-000000000001"


def scalar(name: str, source: str, key: str | list[str], value: Callable[[], Column], sql: str | None) -> None:
    """Register key columns and value = f(columns) of a table."""
    keys = [key] if isinstance(key, str) else key

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*keys, value().alias("value"))

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"SELECT {', '.join(keys)}, {sql} AS value FROM {source}"


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def _bare(w: str) -> str:
    return f"regexp_replace({w}, '^{PUNCT}+|{PUNCT}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _dashed(h: str) -> str:
    return f"regexp_replace(substr({h}, 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


REL = "CASE WHEN {u} = '' THEN 'RELATES_TO' WHEN regexp_matches({u}, '^\\p{{L}}') THEN substr({u}, 1, 64) ELSE 'R_' || substr({u}, 1, 64) END"


def rel_sql(c: str) -> str:
    return REL.format(u=f"regexp_replace(regexp_replace(upper(trim(coalesce({c}, ''))), '[ -]', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')")


def family_sql(kind: str, names: str) -> str:
    cases = [f"WHEN regexp_matches({kind}, '{k}') THEN '{f}'" for f, k in T.FAMILIES] + [f"WHEN regexp_matches({names}, '{k}') THEN '{f}'" for f, k in T.NAME_FAMILIES]
    return f"CASE {' '.join(cases)} WHEN regexp_matches({kind}, '{T.LAST_FAMILY[1]}') THEN '{T.LAST_FAMILY[0]}' ELSE 'generic_other' END"


KEYWORDS = f"list_filter(list_transform({_words('text')}, lambda w: lower({_bare('w')})), lambda w: length(w) > 2 AND NOT list_contains({_in(T.STOP_SHORT)}, w))"
_conv = ["conv_id", "turn"]

scalar("sha256_hex", "documents", "doc_id", lambda: T.sha256_hex(F.col("text")), "sha256(text)")
scalar("md5_uuid", "part", "p_partkey", lambda: T.md5_uuid(F.lit(COLLECTION), F.col("p_name")), _dashed(f"md5('{COLLECTION}:' || p_name)"))
scalar("normalize_path", "pages", "page_id", lambda: T.normalize_path(F.concat(F.lit(" ./"), F.regexp_replace("url", "^https?:/", ""))), "trim(regexp_replace(regexp_replace(regexp_replace(url, '^https?:/', ''), '/+', '/', 'g'), '(.)/$', '\\1'), ' ')[2:]")
scalar("doc_ns_uuid5", "customer", "c_custkey", lambda: T.collection_namespace(F.col("c_name")), None)
scalar("doc_id_path", "pages", "page_id", lambda: T.document_id_for_path(F.lit(COLLECTION), F.col("url")), None)
scalar("doc_id_chunk", "documents", "doc_id", lambda: T.document_id_for_chunk(F.lit(COLLECTION), T.sha256_hex(F.col("text"))), None)
scalar("normalize_rel_type", "orders", "o_orderkey", lambda: T.normalize_rel_type(F.col("o_orderpriority")), rel_sql("o_orderpriority"))
scalar("safe_label", "orders", "o_orderkey", lambda: T.safe_label(F.col("o_orderpriority")), f"regexp_replace({rel_sql('o_orderpriority')}, '[^A-Z0-9_]', '_', 'g')")
scalar("rel_embedding_text", "part", "p_partkey", lambda: T.rel_embedding_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.concat_ws(" ", "p_name", "p_type"), F.split("p_name", " ")), f"'Relationship type: ' || {rel_sql('p_type')} || '. Source: ' || p_name || '. Target: ' || p_brand || '. Description: ' || p_name || ' ' || p_type || ' Keywords: ' || array_to_string(string_split(p_name, ' '), ', ') || '.'")
_TOKENS = "list_transform(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\\p{L}\\p{N}_]+'), lambda t: {'b': CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % 256, 's': 1 - 2 * (CAST(('0x' || substr(sha256(t), 9, 2)) AS BIGINT) % 2)})"
_DENSE = f"list_transform(range(256), lambda d: coalesce(list_sum(list_transform(list_filter({_TOKENS}, lambda t: t.b = d), lambda t: t.s)), 0))"
QUERIES["hash_embedding"] = lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.posexplode(U.hash_embedding(F.concat_ws(" ", "p_name", "p_brand"))).alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))
SQL["hash_embedding"] = f"WITH v AS (SELECT p_partkey, {_DENSE} AS e FROM part), n AS (SELECT p_partkey, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v), u AS (SELECT p_partkey, unnest(e) AS x, unnest(range(256)) AS bucket, l FROM n) SELECT p_partkey, bucket, round(x / l, 6) AS value FROM u WHERE x <> 0"
scalar("strip_diacritics", "documents", "doc_id", lambda: F.sha2(U.strip_diacritics(F.col("text")), 256), None)
scalar("compare_key", "part", "p_partkey", lambda: U.compare_key(F.concat(F.lit("The "), F.col("p_name"))), "regexp_replace(lower(p_name), '[\\s-]', '', 'g')")
scalar("normalize_name", "conversations", _conv, lambda: T.normalize_name(F.col("text")), f"substr({_squeeze('text')}, 1, 256)")
scalar("fuzzy_match", "part", "p_partkey", lambda: U.fuzzy_match(F.col("p_name"), F.concat_ws(" ", "p_name", F.lit("x")), F.lit(False)), None)
scalar("types_compatible", "events", "event_id", lambda: T.types_compatible(F.when(F.col("event_type") == "click", "person").otherwise("object"), F.when(F.col("value") > 10, "Person").otherwise(F.col("event_type"))), "NOT (event_type <> 'click' AND value > 10)")
scalar("is_code_symbol", "supplier", "s_suppkey", lambda: T.is_code_symbol(F.replace("s_name", F.lit("#"), F.lit("_"))), "true")
scalar("needs_exact", "part", "p_partkey", lambda: T.needs_exact(F.col("p_name"), F.when(F.col("p_size") > 25, "function").otherwise("concept"), F.lit(True)), "p_size > 25 OR regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$')")
scalar("query_keywords", "conversations", _conv, lambda: F.array_join(T.query_keywords(F.col("text")), "|"), f"array_to_string(list_concat([text], (SELECT coalesce(list(w ORDER BY p), []) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({KEYWORDS}) AS w, generate_subscripts({KEYWORDS}, 1) AS p) WHERE w <> text GROUP BY w))), '|')")
scalar("query_tokens", "conversations", _conv, lambda: F.array_join(T.query_tokens(F.col("text")), "|"), f"array_to_string(list_sort(list_distinct(list_append({KEYWORDS}, lower(text)))), '|')")
scalar("fallback_keywords", "conversations", _conv, lambda: F.array_join(T.fallback_keywords(F.col("text")), "|"), f"array_to_string(list_filter(list_transform({_words('lower(text)')}, lambda w: {_bare('w')}), lambda w: length(w) > 2 AND NOT list_contains({_in(T.STOP_LONG)}, w)), '|')")
scalar("combined_edge_score", "part", "p_partkey", lambda: F.round(T.combined_edge_score(F.lit(0.5), F.col("p_size"), F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"))), 6), "round(0.25 + 0.3 * least(p_size, 100) / 100.0 + 0.2 * len(list_filter(string_split(p_name, ' '), lambda w: w IN ('small', 'ring'))) / len(string_split(p_name, ' ')), 6)")
scalar("parse_source_ids", "events", "event_id", lambda: F.array_join(T.parse_source_ids(F.when(F.col("event_type") == "click", F.concat(F.lit('["a", "'), F.col("event_type"), F.lit('", " "]'))).otherwise(F.col("props"))), "|"), "CASE WHEN event_type = 'click' THEN 'a|click' ELSE props END")
scalar("parse_json_list", "events", "event_id", lambda: F.array_join(T.parse_json_list(F.when(F.col("event_type") == "click", '["a", "b"]').when(F.col("event_type") == "view", F.col("props")).otherwise(F.col("event_type"))), "|"), "CASE event_type WHEN 'click' THEN 'a|b' WHEN 'view' THEN '' ELSE event_type END")
scalar("try_uuid", "events", "event_id", lambda: T.try_uuid(F.when(F.col("event_type") == "view", F.upper(F.md5(F.col("event_id").cast("string")))).otherwise(F.col("props"))), f"CASE WHEN event_type = 'view' THEN {_dashed('md5(CAST(event_id AS VARCHAR))')} END")
scalar("retrieval_query", "conversations", _conv, lambda: T.retrieval_query(F.lit(T.ENTITY_INSTRUCTION), F.col("text")), "'<Instruct>: " + T.ENTITY_INSTRUCTION.replace("'", "''") + "' || chr(10) || '<Query>: ' || text")
scalar("strip_context_label", "conversations", _conv, lambda: T.strip_context_label(F.concat(F.lit("Context:\n"), F.col("text"))), "text")
scalar("strip_question_prefix", "part", "p_partkey", lambda: T.strip_question_prefix(F.concat(F.lit("  What is "), F.col("p_name"), F.lit("?! "))), "lower(p_name)")
scalar("role_tokens", "customer", "c_custkey", lambda: F.array_join(T.role_tokens(F.concat_ws(" of the ", "c_name", "c_mktsegment")), "|"), "'customer|' || lower(c_mktsegment)")
scalar("role_label", "customer", "c_custkey", lambda: T.role_label(F.lit("application_use"), F.lit("bridge"), F.split(F.lower("c_mktsegment"), " ")), "'Application Use Bridge: ' || lower(c_mktsegment)")
scalar("connects_to_text", "part", "p_partkey", lambda: T.connects_to_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("kind"), F.array(F.lit("USES"), F.lit("OWNS")), F.col("p_size"), F.col("p_size") % 2, F.lit("1.5"), F.array(F.col("p_brand")), F.array().cast("array<string>")), "p_name || ' (' || p_brand || ') connects to ' || p_type || ' (kind) through ' || CAST(p_size AS VARCHAR) || ' direct cross-edge(s) dominated by USES, OWNS' || CASE WHEN p_size % 2 > 0 THEN '; and 1 short directed path(s) with cumulative path score 1.5' ELSE '' END || '; boundary entities: ' || p_brand || '.'")
scalar("strip_code_fence_json", "events", "event_id", lambda: F.get_json_object(T.strip_code_fence(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "$.k"), "CAST(json_extract(props, '$.k') AS VARCHAR)")
scalar("semantic_entity_id", "part", "p_partkey", lambda: T.semantic_entity_id(F.concat(F.lit(" "), F.upper(F.col("p_name")), F.lit("  x "))), "'entity:' || lower(p_name) || ' x'")
scalar("semantic_rel_id", "part", "p_partkey", lambda: T.semantic_rel_id(F.col("p_name"), F.col("p_brand")), "'entity:' || lower(p_name) || '__entity:' || lower(p_brand)")
scalar("md5_parts", "conversations", _conv, lambda: T.md5_parts(F.col("conv_id"), F.col("turn"), F.lit(None)), "md5(CAST(conv_id AS VARCHAR) || '::' || CAST(turn AS VARCHAR) || '::None')")
scalar("format_message", "conversations", _conv, lambda: T.format_message(F.col("role"), F.col("text"), F.col("turn")), "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (turn ' || CAST(turn AS VARCHAR) || '):' || chr(10) || text")
scalar("format_semantic_entity", "part", "p_partkey", lambda: T.format_entity(F.col("p_name"), F.col("p_brand")), "'Entity: ' || p_name || '. ' || p_brand")
scalar("format_semantic_rel", "part", "p_partkey", lambda: T.format_relation(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.split("p_name", " ")), "'Relationship: ' || p_name || ' -> ' || p_brand || '. ' || p_type || ' Keywords: ' || array_to_string(string_split(p_name, ' ')[1:5], ', ') || '.'")
scalar("slugify", "conversations", _conv, lambda: T.slugify(F.col("text")), "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), '^_+|_+$', '', 'g'), ''), 'collection')")
scalar("graph_name", "customer", "c_custkey", lambda: T.graph_name(F.col("c_name"), T.dashed(F.md5(F.col("c_name"))), F.lit("ns")), "'tenant:ns:collection:collection_' || replace(lower(c_name), '#', '_') || '_' || substr(md5(c_name), 1, 8)")
scalar("chat_graph_name", "customer", "c_custkey", lambda: T.chat_graph_name(T.dashed(F.md5(F.col("c_name"))), F.lit("ns")), "'tenant:ns:chat:chat_' || md5(c_name)")


def _meta() -> Column:
    return F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_name"), F.lit("__meta__l"), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_name"), F.lit("__meta"))).otherwise(F.col("p_name"))


scalar("parse_meta_name", "part", "p_partkey", lambda: F.concat_ws("|", T.meta_root(_meta()), T.meta_level(_meta()).cast("string")), "CASE p_size % 3 WHEN 0 THEN p_name || '|' || CAST(p_size AS VARCHAR) WHEN 1 THEN p_name || '|1' ELSE p_name || '|0' END")
scalar("meta_name", "part", "p_partkey", lambda: T.meta_name(_meta(), 2), "p_name || '__meta__l2'")
scalar("meta_name_candidates", "part", "p_partkey", lambda: F.array_join(F.array(T.meta_name(_meta(), 1), F.concat(T.meta_root(_meta()), F.lit("__meta"))), "|"), "p_name || '__meta__l1|' || p_name || '__meta'")
scalar("rel_family", "events", "event_id", lambda: T.rel_group(F.when(F.col("event_type") == "click", "CALLS").otherwise(F.upper("event_type"))), "CASE event_type WHEN 'click' THEN 'behavior' ELSE 'other' END")
scalar("edge_family", "part", "p_partkey", lambda: T.edge_family(F.concat_ws("_", F.when(F.col("p_size") % 2 == 0, "SUPPORTS").otherwise("X"), "p_type"), F.col("p_name"), F.col("p_brand")), family_sql("CASE WHEN p_size % 2 = 0 THEN 'SUPPORTS_' ELSE 'X_' END || upper(p_type)", "lower(p_name || ' ' || p_brand)"))
scalar("mention_key", "pages", "page_id", lambda: T.mention_key(U.casefold(F.col("url"))), f"{_squeeze(f'''regexp_replace(lower(url), '{PUNCT}', ' ', 'g')''')}")
scalar("concept_slug", "customer", "c_custkey", lambda: T.concept_slug(F.concat_ws(" / ", "c_name", "c_mktsegment")), "replace(lower(c_name), '#', '_') || '_' || lower(c_mktsegment)")
