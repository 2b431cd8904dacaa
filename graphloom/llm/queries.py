"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, jpeg, langid, mixing, pfor, quality, simhash, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours, among all vectors, of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and acceptance for every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and thumbnail hashes of every page's picture."""
    return jpeg.describe(jpeg.pages_media(_table(spark, sf_dir, "pages")), "page_id")


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document."""
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, alias group and decision for every page."""
    return urls.decide(_table(spark, sf_dir, "pages"))


def _key(u: str) -> str:
    """DuckDB's form of ``urls.url_key``."""
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', '')"
    port = f"CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':80$', '') WHEN 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    rest = f"regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1)"
    path = f"regexp_extract({rest}, '^([^?]*)', 1)"
    query = f"regexp_replace(regexp_replace('&' || regexp_extract({rest}, '\\?(.*)$', 1), '(?i)&{urls.TRACKING}=[^&]*', '', 'g'), '^&+', '')"
    whole = f"{scheme} || '://' || {port} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    return f"CASE WHEN {bare} = '' THEN NULL WHEN {scheme} <> '' AND {host} <> '' THEN {whole} ELSE {bare} END"


def _named(tag: str, href: str) -> str:
    return f"replace(trim(regexp_extract(regexp_extract(html, '{tag}'), '{href}', 1)), '&amp;', '&')"


def _linked(tag: str, href: str) -> str:
    root = "regexp_extract(p, '^([a-z][a-z0-9+.-]*://[^/?]*)', 1)"
    steps = "list_filter(string_split(regexp_extract(p, '^[a-z][a-z0-9+.-]*://[^/?]*/((?:[^?/]*/)*)', 1), '/'), lambda s: s <> '')"
    near = "regexp_replace(found, '^(\\./)+', '')"
    up = f"(length(regexp_extract({near}, '^((?:\\.\\./)*)', 1)) // 3)"
    folder = f"list_slice({steps}, 1, greatest(0, len({steps}) - {up}))"
    inside = f"{root} || '/' || CASE WHEN len({folder}) > 0 THEN array_to_string({folder}, '/') || '/' ELSE '' END || regexp_replace({near}, '^(\\.\\./)+', '')"
    whole = f"CASE WHEN regexp_matches(found, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN found WHEN starts_with(found, '//') THEN regexp_extract(p, '^([a-z][a-z0-9+.-]*:)', 1) || found WHEN starts_with(found, '/') THEN {root} || found WHEN starts_with(found, '?') THEN regexp_replace(p, '\\?.*$', '') || found ELSE {inside} END"
    return f"SELECT a, CASE WHEN found <> '' THEN {whole} END AS raw FROM (SELECT a, p, {_named(tag, href)} AS found FROM k)"


_QUOTED = "[^\\x22\\x27\\s>]+"
_HREF = f"(?i)\\bhref\\s*=\\s*[\\x22\\x27]?({_QUOTED})"
_BASE = _named("(?i)<base\\b[^>]*>", _HREF)
_FORM = "regexp_replace(regexp_replace(a, '^http://', 'https://'), '^https://(www|m)\\.([^/]*\\.)', 'https://\\2')"
OP6_SQL = f"""
WITH RECURSIVE k AS (SELECT *, CASE WHEN regexp_matches(based, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {_key('based')} ELSE a END AS p FROM (SELECT page_id, url, {_key('url')} AS a, html, {_BASE} AS based FROM pages)),
raw AS ({_linked('(?i)<link\\b[^>]*\\brel\\s*=\\s*[\\x22\\x27]?canonical\\b[^>]*>', _HREF)}
  UNION ALL {_linked('(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\\x22\\x27]?refresh\\b[^>]*>', f'(?i)\\burl\\s*=\\s*[\\x22\\x27]?({_QUOTED})')}),
e AS (SELECT a, {_key('raw')} AS b FROM raw WHERE raw IS NOT NULL
  UNION SELECT a, regexp_replace(regexp_replace({_FORM}, '\\.html?(\\?|$)', '\\1', 'g'), '([^/:])/+(\\?|$)', '\\1\\2', 'g') FROM k),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
n AS (SELECT a AS key FROM k WHERE a IS NOT NULL UNION SELECT a FROM u),
reach AS (SELECT key, key AS label FROM n UNION SELECT u.b, reach.label FROM reach JOIN u ON u.a = reach.key),
g AS (SELECT key, min(label) AS grp FROM reach GROUP BY key),
rules(kind, pattern, action) AS (VALUES {', '.join(str(r) for r in urls.DEFAULT_RULES)}),
m AS (SELECT g.key, grp,
    bool_or(action = 'block') AS own, bool_or(action = 'allow') AS allowed
  FROM g LEFT JOIN rules ON CASE kind
    WHEN 'host' THEN '.' || regexp_replace(regexp_extract(g.key, '^[a-z][a-z0-9+.-]*://([^/?]*)', 1), ':[0-9]+$', '') LIKE '%.' || pattern
    WHEN 'word' THEN list_contains(regexp_split_to_array(regexp_extract(g.key, '^[a-z][a-z0-9+.-]*://([^/?:]*)', 1), '[.-]'), pattern)
    ELSE g.key = pattern OR starts_with(g.key, pattern || '/') OR starts_with(g.key, pattern || '?') END
  GROUP BY ALL),
s AS (SELECT grp, bool_or(coalesce(own, false)) AS spread FROM m GROUP BY grp),
v AS (SELECT key, m.grp, CASE WHEN allowed THEN 'allowed' WHEN own THEN 'own' WHEN spread THEN 'alias' ELSE 'none' END AS reason FROM m JOIN s ON m.grp = s.grp)
SELECT page_id, url, a AS url_key, grp AS "group", coalesce(reason IN ('own', 'alias'), false) AS blocked, coalesce(reason, 'none') AS reason
FROM k LEFT JOIN v ON a = key
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the schedule with the pieces of documents in its block."""
    return mixing.schedule(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(translate(text, chr(32) || chr(10) || chr(13) || chr(9), '')) + 1 END AS n,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
r AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY place, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM d),
s AS (SELECT source, sum(n) AS total, greatest(1, CAST(ceil(sum(n) / 16384.0) AS BIGINT)) AS blocks FROM d GROUP BY source),
w AS (SELECT *, CAST(floor(sqrt(CAST(total AS DOUBLE)) * sqrt(sqrt(CAST(total AS DOUBLE))) * 1000) AS BIGINT) AS weight FROM s),
c AS (SELECT *, sum(weight) OVER (ORDER BY source) AS upto, sum(weight) OVER () AS whole FROM w),
e AS (SELECT source, blocks, CAST(floor(CAST(upto - weight AS DOUBLE) / CAST(whole AS DOUBLE) * 4294967296) AS BIGINT) AS low,
        CAST(floor(CAST(upto AS DOUBLE) / CAST(whole AS DOUBLE) * 4294967296) AS BIGINT) AS high FROM c),
g AS (SELECT i AS slot, (i * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range(CAST((SELECT sum(blocks) FROM s) AS BIGINT))) AS i)),
q AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM g JOIN e ON u >= low AND u < high),
t AS (SELECT slot, source, k // blocks AS epoch, k % blocks AS block FROM q),
p AS (SELECT r.source, doc_id, n, b, unnest(range(least(b // 16384, blocks - 1), least(greatest(b, b + n - 1) // 16384, blocks - 1) + 1)) AS block FROM r JOIN s ON r.source = s.source)
SELECT slot, t.source, epoch, t.block, doc_id, greatest(0, t.block * 16384 - b) AS token_from, least(n, (t.block + 1) * 16384 - b) AS token_to
FROM t JOIN p ON t.source = p.source AND t.block = p.block
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    tokens = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return tokens.select("doc_id", "n_tokens", "token_ids", F.xxhash64("decoded").eqNullSafe(F.col("mark")).alias("round_trip"))


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed ids of every document with the index of its blocks."""
    return pfor.write_ids(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document."""
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_neighbours": op2_neighbours,
    "op3_language": op3_language,
    "op4_media": op4_media,
    "op5_near_copies": op5_near_copies,
    "op6_urls": op6_urls,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_packed_ids": op9_packed_ids,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op6_urls": OP6_SQL, "op7_mixing": OP7_SQL}
