"""Scalar text functions as Column expressions: they stay in the JVM and push down."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STOP_SHORT = "a i be me of an in on to or is at my and the can who for how why with when what".split()
STOP_LONG = "a i be me of an in on do to or is at my had did and the are who for has was how why here were have with will been does this that what would there these those".split()
ROLE_STOP = "a of an in on to or as is by and the for with from into part".split()
PUNCTUATION = r"!-/:-@\[-`{-~"
ZERO_WIDTH = "[​‌‍﻿⁠]"
CODE_TYPES = tuple("CLASS CONFIG EXCEPTION FUNCTION INTERFACE METHOD MODULE PACKAGE VARIABLE".split())
ENTITY_INSTRUCTION = "Find the entities whose description bears on the question."
RELATION_INSTRUCTION = "Find the relations that explain the answer: causes, means and conflicts."
INJECTIONS = (
    r"(?i)ignore\s+(?:all\s+)?pr(?:evious|ior)\s+(?:instruct|direct)ions?",
    r"(?i)you\s+(?:are\s+)?(?:now\s+)?(?:a\s+)?(?:new\s+)?(?:model|system|assistant)",
    r"(?i)disregard\s+(?:all\s+)?pr(?:evious|ior)\s+(?:directive|instruction)s?",
    r"(?i)new\s+(?:directive|instruction)s?\s*:",
    r"<\s*system\s*>",
    r"(?i)base64\s*:\s*[0-9a-z+/=]{50,}",
)
MOST_CHARS = 16_000
#: Ordered: the first family with a key inside the upper-case type wins.
FAMILIES = (
    ("bibliographic", "AUTHOR|PUBLISHER|PUBLICATION|CITES"),
    ("constraint", "CONTRA|LIMIT|AVOID|PROHIBIT|RESTRICT"),
    ("temporal", "PRECEDE|FOLLOW|BEFORE|AFTER|DURATION|SEQUENCE"),
    ("location_path", "LOCATED|TRAVEL|PASS|EXTEND|PATH|THROUGH|NEAR|BETWEEN|ALONG"),
    ("compositional", "PART|CONTAIN|INCLUDE|COMPOSE|CHAPTER|COMPONENT"),
    ("taxonomic", "IS_A|INSTANCE|VARIATION|SUBTYPE|CLASSIF|CATEGOR|LINEAGE"),
    ("definitional", "DEFINE|ATTRIBUTE|QUALITY|CHARACTER|IDENTIF|INDICATE"),
    ("supporting_evidence", "SUPPORT|EVIDENCE|INFORM|REFERENCE|DISCUSS|COVER|TOPIC|EXAMPLE|STUDIED"),
    ("representation", "CONNECT|CORRESPOND|DESCRIBE|EXPLAIN|REPRESENT|MAP|SYMBOL"),
    ("application_use", "USE|UTILIZ|APPL|REQUIRE|INVOLVE|TARGET|GUIDE|FACILITATE|ENABLE|ASSIST"),
    ("regulatory", "CONTROL|REGULAT|BALANCE|MAINTAIN|GOVERN|STIMULAT|ACTIVAT|AWAKEN|ENHANCE"),
    ("therapeutic", "TREAT|ALLEVIAT|CALM|IMPROVE|REDUCE|ELIMINAT|PURIF|STRENGTHEN|BENEFIT"),
    ("causal", "CAUSE|LEAD|RESULT|INFLUENCE|PRODUCE|INDUCE|TRIGGER|CREATE|AFFECT|ALTER|DEVELOP"),
)
NAME_FAMILIES = (("application_use", "practice|technique|method|uses|used in"), ("causal", "effect|outcome|state|sensation|manifests"))
LAST_FAMILY = ("associative", "ASSOCIATED|RELATED|INTERACT|COMBINED|CO_EQUAL")
#: For ties between families.
FAMILY_ORDER = tuple("definitional taxonomic compositional causal regulatory therapeutic constraint temporal supporting_evidence representation application_use location_path bibliographic associative generic_other".split())
_GROUPS = {"behavior": "CALLS USES DEPENDS_ON REFERENCES IMPORTS", "structure": "DEFINES EXTENDS IMPLEMENTS", "evidence": "DOCUMENTS TESTS", "generic": "RELATES_TO"}
REL_GROUPS = {kind: group for group, kinds in _GROUPS.items() for kind in kinds.split()}


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def dashed(hexes: Column) -> Column:
    """32 hexadecimal digits as a UUID."""
    return F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def md5_uuid(collection: Column, name: Column) -> Column:
    return dashed(F.md5(F.concat(collection, F.lit(":"), name)))


def uuid5(namespace: Column, name: Column) -> Column:
    """RFC 4122 version 5: SHA-1 of the namespace's bytes and the name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return dashed(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def collection_namespace(collection: Column, prefix: str = "collection:") -> Column:
    """Two systems give the same ids if they use the same prefix."""
    return uuid5(F.lit(NAMESPACE_URL), F.concat(F.lit(prefix), collection))


def normalize_path(c: Column) -> Column:
    """Slashes only, none doubled or final, no '.' steps; two leading slashes stay two."""
    path = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    head = F.when(path.rlike("^//([^/]|$)"), "/").otherwise("")
    flat = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(\./|\.$)+", "$1")
    flat = F.regexp_replace(flat, "(.)/$", "$1")
    return F.when(path == "", "").when(flat == "", ".").otherwise(F.concat(head, flat))


def document_id_for_path(collection: Column, path: Column) -> Column:
    """Empty paths are an error."""
    flat = normalize_path(path)
    return F.when(flat == "", F.raise_error(F.lit("a document path is required")).cast("string")).otherwise(uuid5(collection_namespace(collection), flat))


def document_id_for_chunk(collection: Column, chunk_hash: Column) -> Column:
    return uuid5(collection_namespace(collection), F.concat(F.lit("chunk:"), F.lower(F.trim(chunk_hash))))


def normalize_rel_type(c: Column) -> Column:
    up = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[ -]", "_"), r"[^\p{L}\p{N}_]", "")
    cut = F.substring(up, 1, 64)
    return F.when(up == "", "RELATES_TO").when(cut.rlike(r"^\p{L}"), cut).otherwise(F.concat(F.lit("R_"), cut))


def safe_label(c: Column) -> Column:
    label = F.regexp_replace(normalize_rel_type(c), "[^A-Z0-9_]", "_")
    return F.when(label.rlike("^[A-Z]"), label).otherwise(F.concat(F.lit("R_"), label))


def rel_embedding_text(source: Column, target: Column, rel_type: Column, description: Column, keywords: Column) -> Column:
    listed = F.array_join(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != ""), ", ")
    text = F.concat(F.lit("Relationship type: "), normalize_rel_type(rel_type), F.lit(". Source: "), source, F.lit(". Target: "), target, F.lit(". Description: "), description)
    return F.when(listed == "", text).otherwise(F.concat(text, F.lit(" Keywords: "), listed, F.lit(".")))


def normalize_name(c: Column) -> Column:
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, 256)


def types_compatible(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    pair = F.concat(F.least(x, y), F.lit("|"), F.greatest(x, y))
    return (x == "") | (y == "") | (x == y) | ~pair.isin("person|place", "object|person", "concept|place")


def is_code_symbol(c: Column) -> Column:
    return F.coalesce(c.rlike(r"""[._\[\](){}'"`:/\\]|^[A-Za-z_][A-Za-z0-9_]*$"""), F.lit(False))


def needs_exact(name: Column, entity_type: Column, domain_exact: Column) -> Column:
    return domain_exact & (F.upper(F.trim(F.coalesce(entity_type, F.lit("")))).isin(*CODE_TYPES) | is_code_symbol(name))


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def query_keywords(question: Column) -> Column:
    """The question itself, then its telling words, each once."""
    found = F.filter(F.transform(words(question), lambda w: F.lower(strip_punctuation(w))), lambda w: (F.length(w) > 2) & ~F.array_contains(_listed(STOP_SHORT), w))
    return F.array_distinct(F.concat(F.array(question), found))


def query_tokens(question: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(query_keywords(question), lambda w: F.lower(w))))


def fallback_keywords(question: Column) -> Column:
    """Telling words by a longer stop list, repeats kept."""
    return F.filter(F.transform(words(F.lower(question)), strip_punctuation), lambda w: (F.length(w) > 2) & ~F.array_contains(_listed(STOP_LONG), w))


def combined_edge_score(cosine: Column, weight: Column, keywords: Column, tokens: Column) -> Column:
    """Half similarity, 0.3 weight (of 100 at most), 0.2 share of keywords among the question's tokens."""
    clean = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    hits = F.size(F.filter(clean, lambda k: F.array_contains(tokens, k)))
    share = F.coalesce(F.try_divide(hits, F.size(clean)), F.lit(0.0))
    return 0.5 * cosine + 0.3 * F.least(F.coalesce(weight, F.lit(0)), F.lit(100)) / 100.0 + 0.2 * share


def parse_source_ids(c: Column) -> Column:
    """A JSON list, or a bare string as a list of one; blanks dropped."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    listed = F.when(text.rlike(r"(?s)^\[.*\]$"), F.coalesce(parsed, F.array(text))).otherwise(F.array(text))
    return F.filter(listed, lambda x: F.trim(x) != "")


def parse_json_list(c: Column) -> Column:
    """A JSON list, blanks dropped; other JSON gives an empty list; text that isn't JSON a list of one."""
    listed = F.filter(F.from_json(c, "array<string>"), lambda x: F.trim(x) != "")
    other = F.when(F.try_parse_json(c).isNotNull() | (F.trim(c) == ""), F.array().cast("array<string>")).otherwise(F.array(c))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.trim(c).rlike(r"(?s)^\[.*\]$") & listed.isNotNull(), listed).otherwise(other)


def try_uuid(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^urn:|uuid:|^[{]+|[}]+$", ""), "-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed(bare))


def retrieval_query(instruction: Column, question: Column) -> Column:
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), question)


def relation_query(question: Column, rel_type: str | None = None) -> Column:
    focus = "" if not rel_type else " Focus on relationships whose semantic role is "
    ask = F.lit(RELATION_INSTRUCTION) if not rel_type else F.concat(F.lit(RELATION_INSTRUCTION + focus), normalize_rel_type(F.lit(rel_type)), F.lit("."))
    return retrieval_query(ask, rel_embedding_text(F.lit("user-question"), F.lit("graph-answer"), F.lit(rel_type or ""), question, F.array().cast("array<string>")))


def strip_context_label(c: Column) -> Column:
    return F.regexp_replace(c, r"^Context:\n", "")


def strip_question_prefix(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(c), r"^[?!.,:; ]+|[?!.,:; ]+$", ""))
    rest = F.trim(F.regexp_replace(bare, "^(what is |who is |what are |who are |tell me about |explain )", ""))
    return F.when(rest != "", rest).otherwise(bare)


def edge_family(rel_type: Column, source: Column, target: Column) -> Column:
    """The first family whose keys occur in the type, then in the names."""
    kind, names = F.upper(rel_type), F.lower(F.concat_ws(" ", source, target))
    (first, keys), *rest = FAMILIES
    found = F.when(kind.rlike(keys), first)
    for family, keys in rest:
        found = found.when(kind.rlike(keys), family)
    for family, keys in NAME_FAMILIES:
        found = found.when(names.rlike(keys), family)
    return found.when(kind.rlike(LAST_FAMILY[1]), LAST_FAMILY[0]).otherwise("generic_other")


def direction_role(out: Column, into: Column) -> Column:
    return F.when(out + into == 0, "isolated").when(out >= 2 * into, "source").when(into >= 2 * out, "sink").otherwise("bridge")


def role_tokens(name: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("([a-z][a-z0-9]{2,})")), lambda t: ~F.array_contains(_listed(ROLE_STOP), t))


def role_label(family: Column, direction: Column, tokens: Column) -> Column:
    shown = F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 3), " / ")).otherwise("mixed terms")
    return F.concat(F.initcap(F.replace(family, F.lit("_"), F.lit(" "))), F.lit(" "), F.initcap(direction), F.lit(": "), shown)


def connects_to_text(source: Column, source_note: Column, target: Column, target_note: Column, types: Column, count: Column, paths: Column, path_score: Column, boundary: Column, bridges: Column, code: bool = False) -> Column:
    """A sentence, or pseudo-code, on how two concepts meet."""
    joined = lambda c: F.array_join(c, ", ")
    some = lambda c, *parts: F.when(c, F.concat(*parts))
    if code:
        parts = [
            F.concat(F.lit("WHEN "), source, F.lit(" is active, THEN flow reaches "), target, F.lit(" mainly via "), joined(types), F.lit("; direct_cross_edges="), count),
            some((source_note != "") | (target_note != ""), F.lit("CONTEXT: "), source, F.lit("="), F.coalesce(F.nullif(source_note, F.lit("")), F.lit("n/a")), F.lit("; "), target, F.lit("="), F.coalesce(F.nullif(target_note, F.lit("")), F.lit("n/a"))),
            some(F.size(boundary) > 0, F.lit("USING boundary_entities=["), joined(boundary), F.lit("]")),
            some(paths > 0, F.lit("FOR short_paths in range("), paths, F.lit("): cumulative_path_score="), path_score),
            some(F.size(bridges) > 0, F.lit("BRIDGE VIA ["), joined(bridges), F.lit("]")),
        ]
    else:
        parts = [
            F.concat(source, F.lit(" ("), source_note, F.lit(") connects to "), target, F.lit(" ("), target_note, F.lit(") through "), count, F.lit(" direct cross-edge(s) dominated by "), joined(types)),
            some(paths > 0, F.lit("and "), paths, F.lit(" short directed path(s) with cumulative path score "), path_score),
            some(F.size(boundary) > 0, F.lit("boundary entities: "), joined(boundary)),
            some(F.size(bridges) > 0, F.lit("bridge entities: "), joined(bridges)),
        ]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def strip_code_fence(c: Column) -> Column:
    """The JSON inside a fenced block, as text; unfenced text as it is."""
    bare = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(bare)


def semantic_entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity:"), squeeze(F.lower(name)))


def semantic_rel_id(source: Column, target: Column) -> Column:
    return F.concat(semantic_entity_id(source), F.lit("__"), semantic_entity_id(target))


def md5_parts(*parts: Column) -> Column:
    """Nulls count as 'None', as text would show them."""
    return F.md5(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def format_message(role: Column, content: Column, turn: Column) -> Column:
    return F.concat(F.when(role == "user", "User").otherwise("Assistant"), F.lit(" (turn "), turn, F.lit("):\n"), content)


def format_entity(name: Column, description: Column) -> Column:
    return F.trim(F.concat(F.lit("Entity: "), name, F.lit(". "), description))


def format_relation(source: Column, target: Column, description: Column, keywords: Column) -> Column:
    listed = F.array_join(F.slice(keywords, 1, 5), ", ")
    suffix = F.when(listed == "", "").otherwise(F.concat(F.lit(" Keywords: "), listed, F.lit(".")))
    return F.trim(F.concat(F.lit("Relationship: "), source, F.lit(" -> "), target, F.lit(". "), description, suffix))


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, 48), "^_+|_+$", ""), F.lit("")), F.lit("collection"))


def graph_name(name: Column, collection: Column, namespace: Column | None = None) -> Column:
    own = F.concat(F.lit("collection_"), slugify(name), F.lit("_"), F.substring(F.replace(collection, F.lit("-"), F.lit("")), 1, 8))
    return own if namespace is None else F.concat(F.lit("tenant:"), namespace, F.lit(":collection:"), own)


def chat_graph_name(chat: Column, namespace: Column | None = None) -> Column:
    own = F.concat(F.lit("chat_"), F.replace(chat, F.lit("-"), F.lit("")))
    return own if namespace is None else F.concat(F.lit("tenant:"), namespace, F.lit(":chat:"), own)


LEVELED = r"^(.+)__meta__l([1-9][0-9]*)$"


def meta_root(c: Column) -> Column:
    return F.when(c.rlike(LEVELED), F.regexp_extract(c, LEVELED, 1)).when(c.rlike("^(.+)__meta$"), F.regexp_extract(c, "^(.+)__meta$", 1)).otherwise(c)


def meta_level(c: Column) -> Column:
    """0 for a base collection, 1 for the old suffix without a level."""
    return F.when(c.rlike(LEVELED), F.regexp_extract(c, LEVELED, 2).cast("int")).when(c.rlike("^(.+)__meta$"), 1).otherwise(0)


def meta_name(c: Column, level: int = 1) -> Column:
    if level < 1:
        raise ValueError("a meta level is 1 at least")
    return F.concat(meta_root(c), F.lit(f"__meta__l{level}"))


def rel_group(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REL_GROUPS.items() for x in kv]), c), F.lit("other"))


def concept_slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 96)


def mention_key(folded: Column) -> Column:
    """Of case-folded text: ASCII punctuation becomes blanks, blanks collapse."""
    return squeeze(F.regexp_replace(folded, f"[{PUNCTUATION}]", " "))


def ngrams(key: Column, most: int = 4) -> Column:
    """All runs of 1 to ``most`` words.

    The words are bound as a variable: as an expression, each run would split the whole text again.
    """
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))

        return F.concat(*[F.when(F.size(w) >= n, of(n)).otherwise(none) for n in range(1, most + 1)])

    return F.transform(F.array(F.filter(F.split(key, " "), lambda x: x != "")), runs)[0]


def injection_count(c: Column) -> Column:
    total = F.lit(0)
    for pattern in INJECTIONS:
        total = total + F.regexp_count(c, F.lit(pattern))
    return total


def severity(count: Column) -> Column:
    return F.when(count == 0, "none").when(count <= 2, "low").when(count <= 5, "medium").otherwise("high")
