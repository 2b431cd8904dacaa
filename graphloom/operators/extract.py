"""The deterministic part of triple extraction: parse, normalise, merge and glean. The model is a plug-in that returns JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text

ENDPOINT = "struct<name:string,description:string>"
TRIPLES = "chunk_id string, pass int, ord int, source string, source_description string, target string, target_description string, rel_type string, description string, keywords array<string>, weight double"
#: Triples that a Python worker hands over at once.
ROWS = 4_096
_OPERATIONS = {
    "value_operations": "evaluate compare convert construct destructure",
    "name_place_operations": "bind rebind mutate access",
    "control_operations": "branch iterate call return signal handle",
    "effect_operations": "communicate allocate_resource release_resource synchronize",
}
TAXONOMY = {group: tuple(names.split()) for group, names in _OPERATIONS.items()}


def endpoint(value: object) -> tuple[str, str] | None:
    """(name, description) of a bare name or an object; None if there is no name."""
    if isinstance(value, str):
        name, note = value, ""
    elif isinstance(value, dict):
        name, note = str(value.get("name") or ""), str(value.get("description") or "")
    else:
        return None
    name = " ".join(name.split())[:256]
    return (name, note.strip()) if name else None


def keyword_list(value: object, fallback: list[str] | None = None) -> list[str]:
    """A list, or names between commas; blanks dropped."""
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else None
    return list(fallback or []) if parts is None else [k for k in (str(p).strip() for p in parts) if k]


def endpoint_name(value: Column) -> Column:
    """Name of an end given as JSON, a string or an object; null if there is none."""
    name = F.coalesce(F.get_json_object(value, "$.name"), F.when(F.trim(value).startswith('"'), F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")))
    return F.nullif(F.substring(text.squeeze(name), 1, 256), F.lit(""))


def keywords_of(value: Column) -> Column:
    """Names between commas; blanks dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda k: F.trim(k)), lambda k: k != "")


def weight_of(value: object, fallback: float) -> float:
    try:
        return min(1.0, max(0.0, float(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return fallback


def _type(name: object) -> str:
    kept = "".join(c for c in str(name or "").strip().upper().replace(" ", "_").replace("-", "_") if c.isalnum() or c == "_")[:64]
    return "RELATES_TO" if not kept else kept if kept[0].isalpha() else "R_" + kept


def typed(value: object, description: str, keywords: list[str], weight: float, vocabulary: frozenset[str] | None = None) -> list[tuple[str, str, list[str], float]]:
    """One (type, description, keywords, weight) per entry of a string, a list of strings or a list of objects.

    A vocabulary drops other types; what is left empty becomes RELATES_TO.
    """
    out = []
    for entry in value if isinstance(value, list) else [value]:
        more = entry if isinstance(entry, dict) else {}
        name = more.get("name") or more.get("rel_type") if more else entry
        kind = _type(name)
        if not name or (vocabulary is not None and kind not in vocabulary):
            continue
        out.append((kind, str(more.get("description") or description), keyword_list(more.get("keywords"), keywords), weight_of(more.get("weight"), weight)))
    return out or [("RELATES_TO", description, keywords, weight)]


def triples_of(payload: object, vocabulary: frozenset[str] | None = None) -> list[tuple]:
    """(source, note, target, note, type, description, keywords, weight) of the generic form or the code taxonomy."""
    if not isinstance(payload, dict):
        return []
    found = payload.get("relationships")
    items: list[tuple[dict, object]] = []
    if isinstance(found, list):
        items = [(r, r.get("rel_type")) for r in found if isinstance(r, dict)]
    else:
        groups = {str(k).lower(): v for k, v in (found if isinstance(found, dict) else payload).items()}
        for group, operations in TAXONOMY.items():
            inner = groups.get(group)
            inner = {str(k).lower(): v for k, v in inner.items()} if isinstance(inner, dict) else {}
            items += [(r, op.upper()) for op in operations for r in inner.get(op) or [] if isinstance(r, dict)]
    out = []
    for r, kind in items:
        source, target = endpoint(r.get("source")), endpoint(r.get("target"))
        if source and target:
            base = str(r.get("description") or ""), keyword_list(r.get("keywords")), weight_of(r.get("weight"), 1.0)
            out += [(*source, *target, *t) for t in typed(kind, *base, vocabulary)]
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def extracted(chunks: DataFrame, model: Callable[[str, list[tuple]], str], passes: int = 1, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """Triples of every chunk (chunk_id, content): a first pass and up to ``passes`` gleanings that stop when nothing new comes.

    ``model(text, known)`` returns JSON text; one that can't be read is asked for once more, then counts as empty.
    """

    def ask(content: str, known: list[tuple]) -> list[tuple]:
        for _ in range(2):
            try:
                return triples_of(json.loads(model(content, known)), vocabulary)
            except (ValueError, TypeError):
                continue
        return []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk_id", pa.string()), ("pass", pa.int32()), ("ord", pa.int32()), *[(n, pa.string()) for n in ("source", "source_description", "target", "target_description", "rel_type", "description")], ("keywords", pa.list_(pa.string())), ("weight", pa.float64())])
        rows: list[tuple] = []
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                known: dict[tuple, tuple] = {}
                for p in range(passes + 1):
                    new = ask(content.as_py() or "", list(known.values()))
                    before = len(known)
                    rows += [(key.as_py(), p, i, *t) for i, t in enumerate(new)]
                    known.update({(t[0], t[2], t[4]): t for t in new})
                    if not new or (p and len(known) == before):
                        break
                while len(rows) >= ROWS:
                    yield _batch(rows[:ROWS], schema)
                    del rows[:ROWS]
        yield _batch(rows, schema)

    return chunks.select(F.col("chunk_id").cast("string"), F.col("content").cast("string")).mapInArrow(run, TRIPLES)


def merged_relations(triples: DataFrame) -> DataFrame:
    """One row per (chunk, source, target, type): the last pass's words in the first one's place."""
    keys = ["chunk_id", "source", "target", "rel_type"]
    at = F.struct("pass", "ord")
    rows = triples.groupBy(*keys).agg(F.min(at).alias("first"), F.max_by(F.struct("description", "keywords", "weight"), at).alias("last"))
    return rows.select(*keys, "last.*", F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")).alias("ord"))


def merged_entities(triples: DataFrame, kind: str = "CONCEPT") -> DataFrame:
    """(chunk_id, name, description, entity_type, ord): ends of triples in order of appearance with their longest description."""
    ends = triples.select("chunk_id", F.posexplode(F.array(F.struct(F.col("source").alias("name"), F.col("source_description").alias("note")), F.struct(F.col("target").alias("name"), F.col("target_description").alias("note")))), "pass", "ord")
    ends = ends.select("chunk_id", "col.name", "col.note", F.struct("pass", "ord", "pos").alias("at"))
    rows = ends.groupBy("chunk_id", "name").agg(F.max_by("note", F.struct(F.length("note").alias("n"), F.struct(-F.col("at.pass"), -F.col("at.ord"), -F.col("at.pos")).alias("o"))).alias("description"), F.min("at").alias("first"))
    return rows.select("chunk_id", "name", "description", F.lit(kind).alias("entity_type"), F.row_number().over(Window.partitionBy("chunk_id").orderBy("first")).alias("ord"))


def resolved_relations(triples: DataFrame) -> DataFrame:
    """(a, b, rel_type, weight, keywords): either direction is one relation; weights add up to 100, keywords are united."""
    rows = triples.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), text.normalize_rel_type(F.col("rel_type")).alias("rel_type"), (F.col("weight") * 10).cast("int").alias("w"), "keywords")
    return rows.groupBy("a", "b", "rel_type").agg(F.least(F.sum("w"), F.lit(100)).cast("int").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"))
