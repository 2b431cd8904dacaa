"""URL filters with redirect equivalence.

Aliases of a page share its fate. Edges come from three places: redirects (an
optional table), canonical links and refreshes in the page's markup, and the
redirects that servers make between forms of one address (http to https,
``www.`` and ``m.`` hosts, a trailing slash, ``.html``). Distributed connected
components over them give the alias groups. A rule names a host (with the
hosts below it), a word of a host, or an address with all that begin with it
up to a path boundary; rules are a table that is joined by key, so lists of
millions of hosts work. A block decision spreads to the whole group; a
row whose own address matches an allow rule is never blocked, but doesn't free its
aliases.

Addresses are compared by key: lower-case scheme and host, no user, default
port, fragment or tracking parameters.

Defined results: a null or blank URL has a null key and is kept (reason
'none'); an address without a host is a key as it stands. Rows with equal keys
are aliases; repeated rows each get a row; of the links of one kind on a page
the first counts. Null markup has no links; a link that isn't absolute is
resolved against the page's ``<base href>`` if that is absolute, else against
the page's own address: its folder, less one for each leading ``../``. Rules
with null or empty patterns are ignored. Very long addresses and markup are
read whole. Null page_ids pass; other columns are
ignored by ``decide`` and passed on by ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _shared, components

RULES = "kind string, pattern string, action string"
#: The production list of the registered query: kind 'host', 'word' or 'prefix'; action 'block' or 'allow'.
DEFAULT_RULES = [("word", w, "block") for w in ("adult", "ads", "bets", "casino", "malware", "phish", "pills", "porn", "spam", "warez", "xxx")] + [
    ("prefix", "https://adult-x.example.com/de", "allow"),
    ("host", "cheap-pills.example.net", "allow"),
]
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid)"
REASONS = ("allowed", "own", "alias", "none")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: nested uses of a plain column expression double at each level."""
    return F.transform(F.array(value), body)[0]


def url_key(url: Column) -> Column:
    """The form in which addresses are compared."""

    def assembled(p: Column) -> Column:
        host = F.when(p["scheme"] == "http", F.regexp_replace(p["host"], r":80$", "")).when(p["scheme"] == "https", F.regexp_replace(p["host"], r":443$", "")).otherwise(p["host"])
        whole = F.concat(p["scheme"], F.lit("://"), host, F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
        return F.when(p["bare"] == "", F.lit(None)).when((p["scheme"] != "") & (p["host"] != ""), whole).otherwise(p["bare"])

    def parts(bare: Column) -> Column:
        rest = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*"
        query = F.concat(F.lit("&"), F.regexp_extract(bare, rest + r"[^?]*\?(.*)$", 1))
        return F.struct(
            bare.alias("bare"),
            F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
            F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^.*@", "").alias("host"),
            F.regexp_extract(bare, rest + r"([^?]*)", 1).alias("path"),
            F.regexp_replace(F.regexp_replace(query, rf"(?i)&{TRACKING}=[^&]*", ""), r"^&+", "").alias("query"),
        )

    return _let(F.regexp_replace(F.trim(url), r"#.*$", ""), lambda bare: _let(parts(bare), assembled))


def served_form(key: Column) -> Column:
    """Where a server usually redirects a key to."""
    form = F.regexp_replace(F.regexp_replace(key, r"^http://", "https://"), r"^https://(www|m)\.([^/]*\.)", "https://$2")
    return F.regexp_replace(F.regexp_replace(form, r"\.html?(\?|$)", "$1"), r"([^/:])/+(\?|$)", "$1$2")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def absolute(found: Column, page: Column) -> Column:
    """The key of a link on a page."""
    root = F.regexp_extract(page, r"^([a-z][a-z0-9+.-]*://[^/?]*)", 1)
    steps = F.filter(F.split(F.regexp_extract(page, r"^[a-z][a-z0-9+.-]*://[^/?]*/((?:[^?/]*/)*)", 1), "/"), lambda s: s != "")
    near = F.regexp_replace(found, r"^(\./)+", "")
    up = (F.length(F.regexp_extract(near, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    folder = F.array_join(F.slice(steps, F.lit(1), F.greatest(F.lit(0), F.size(steps) - up)), "/")
    inside = F.concat(root, F.lit("/"), F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), F.regexp_replace(near, r"^(\.\./)+", ""))
    whole = F.when(found.rlike(_SCHEME), found).when(found.startswith("//"), F.concat(F.regexp_extract(page, r"^([a-z][a-z0-9+.-]*:)", 1), found))
    whole = whole.when(found.startswith("/"), F.concat(root, found)).when(found.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), found)).otherwise(inside)
    return F.when(found != "", url_key(whole))


def _named(html: Column, tag: str, href: str) -> Column:
    """The address in the first tag of a kind; empty if there is none."""
    return F.regexp_replace(F.trim(F.regexp_extract(F.regexp_extract(html, tag, 0), href, 1)), "&amp;", "&")


def _link(html: Column, page: Column, tag: str, href: str) -> Column:
    """The key of the address that a tag names."""
    return _let(_named(html, tag, href), lambda found: absolute(found, page))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) from canonical links, refreshes and served forms of (url, html)."""
    _shared.require(pages, "url", "html")
    rows = pages.select(url_key(F.col("url").cast("string")).alias("a"), F.col("html").cast("string").alias("html"))
    based = _let(_named(F.col("html"), r"(?i)<base\b[^>]*>", _HREF), lambda found: F.when(found.rlike(_SCHEME), url_key(found)))
    rows = rows.withColumn("page", F.coalesce(based, "a"))
    canonical = _link(F.col("html"), F.col("page"), r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", _HREF)
    refresh = _link(F.col("html"), F.col("page"), r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    return rows.select("a", F.explode(F.array_compact(F.array(canonical, refresh, served_form(F.col("a"))))).alias("b"))


def _matches(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, blocked, allowed) of the keys that a rule names; one join on what rules can name."""
    host = F.regexp_replace(F.regexp_extract("key", r"^[a-z][a-z0-9+.-]*://([^/?]*)", 1), r":[0-9]+$", "")
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host|"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.split(host, r"[.\-]"), lambda w: F.concat(F.lit("word|"), w))
    steps = F.split(F.regexp_replace("key", r"\?.*$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("prefix|"), F.array_join(F.slice(steps, 1, i), "/")))
    named = keys.select("key", F.explode(F.array_distinct(F.concat(hosts, words, prefixes, F.array(F.concat(F.lit("prefix|"), F.col("key")))))).alias("name"))
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace("pattern", r"([^/:])/+$", "$1")).otherwise(F.lower("pattern"))
    known = rules.where(F.col("pattern") != "").select(F.concat("kind", F.lit("|"), pattern).alias("name"), "action").distinct()
    return named.join(known, "name").groupBy("key").agg(F.bool_or(F.col("action") == "block").alias("blocked"), F.bool_or(F.col("action") == "allow").alias("allowed"))


def _decided(keys: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, group, verdict) of every distinct key; keys that only edges name take part."""
    found = components.components(edges).select(F.col("node").alias("key"), F.col("component").alias("group"))
    every = keys.unionByName(found.select("key")).distinct()
    marked = every.join(_matches(every, rules), "key", "left").join(found, "key", "left")
    marked = _shared.cut(marked.select("key", F.coalesce("group", "key").alias("group"), F.coalesce("blocked", F.lit(False)).alias("own"), F.coalesce("allowed", F.lit(False)).alias("allowed")))
    spread = marked.where("own").select("group").distinct().withColumn("spread", F.lit(True))
    verdict = F.when(F.col("allowed"), "allowed").when(F.col("own"), "own").when(F.col("spread"), "alias").otherwise("none")
    return marked.join(spread, "group", "left").select("key", "group", verdict.alias("reason"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES)


def decide(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, url_key, group, blocked, reason) of every row.

    ``redirects`` has from_url and to_url. reason: 'allowed' by a rule on the
    address itself, blocked by its 'own' rule, blocked as an 'alias', or 'none'.
    """
    _shared.require(pages, "page_id", "url", "html")
    rules = rules if rules is not None else default_rules(pages.sparkSession)
    _shared.require(rules, "kind", "pattern", "action")
    edges = page_edges(pages)
    if redirects is not None:
        _shared.require(redirects, "from_url", "to_url")
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url").cast("string")).alias("a"), url_key(F.col("to_url").cast("string")).alias("b")))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("key", url_key(F.col("url")))
    decided = _decided(rows.select("key").where(F.col("key").isNotNull()), edges, rules)
    reason = F.coalesce("reason", F.lit("none"))
    return rows.join(decided, "key", "left").select("page_id", "url", F.col("key").alias("url_key"), "group", reason.isin("own", "alias").alias("blocked"), reason.alias("reason"))


def keep(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """The rows that aren't blocked, with all their columns."""
    gone = decide(pages, rules, redirects).where("blocked").select(F.col("url").alias("_gone_url")).distinct()
    return pages.join(gone, pages["url"].cast("string") == gone["_gone_url"], "left_anti")
