"""Texts for models: known graphs, taxonomy, questions derived from candidates, and references to base entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import extract


def _lines(rows: DataFrame, line: Column, glue: str) -> DataFrame:
    """(chunk_id, lines): one line per row in order."""
    listed = rows.select("chunk_id", F.struct("ord", line.alias("line")).alias("l")).groupBy("chunk_id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return listed.select("chunk_id", F.array_join(F.transform("l", lambda x: x["line"]), glue).alias("lines"))


def existing(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(chunk_id, known): what was extracted before, in a line of names and one of relations."""
    names = _lines(entities, F.col("name"), ", ").withColumnRenamed("lines", "e")
    edges = _lines(relations, F.concat("source", F.lit(" -["), "rel_type", F.lit("]-> "), "target"), ", ").withColumnRenamed("lines", "r")
    both = names.join(edges, "chunk_id", "full_outer")
    none = F.lit("(none)")
    return both.select("chunk_id", F.concat(F.lit("Already extracted:\nEntities: "), F.coalesce("e", none), F.lit("\nRelationships: "), F.coalesce("r", none)).alias("known"))


def candidates(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(chunk_id, graph): entities and relations with their descriptions, a line each."""
    names = _lines(entities, F.concat(F.lit("- "), "name", F.lit(" ["), "entity_type", F.lit("]: "), "description"), "\n").withColumnRenamed("lines", "e")
    told = F.concat(F.lit("- "), "source", F.lit(" -["), "rel_type", F.lit("]-> "), "target", F.lit(": "), "description", F.lit(" | keywords="), F.array_join("keywords", ", "), F.lit(" | weight="), F.col("weight").cast("string"))
    both = names.join(_lines(relations, told, "\n").withColumnRenamed("lines", "r"), "chunk_id", "full_outer")
    none = F.lit("- (none)")
    return both.select("chunk_id", F.concat(F.lit("Entities:\n"), F.coalesce("e", none), F.lit("\nRelationships:\n"), F.coalesce("r", none)).alias("graph"))


def taxonomy_schema() -> dict:
    """JSON schema of the code taxonomy: a list of relations for each operation of each group."""
    end = {"type": "object", "properties": {"name": {"type": "string"}, "description": {"type": "string"}}, "required": ["name"]}
    relation = {"type": "object", "properties": {"source": end, "target": end, "description": {"type": "string"}, "keywords": {"type": "array", "items": {"type": "string"}}, "weight": {"type": "number"}}, "required": ["source", "target"]}
    group = lambda names: {"type": "object", "properties": {n: {"type": "array", "items": relation} for n in names}, "required": list(names)}
    return {"type": "object", "properties": {g: group(names) for g, names in extract.TAXONOMY.items()}, "required": list(extract.TAXONOMY)}


def taxonomy_rules() -> str:
    """What a model is told about the taxonomy."""
    head = ["Relation types of code are fixed: take one of those below.", "Give every group and every type, an empty list where nothing fits."]
    return "\n".join([*head, *[f"{group}: {', '.join(n.upper() for n in names)}" for group, names in extract.TAXONOMY.items()]])


def extraction(text: str, entity_types: list[str], rel_types: list[str], known: str = "") -> str:
    """A prompt for a first pass, or for a further one if something is known."""
    parts = ["List the relations that the text states, with both ends, a type, a description, keywords and a weight from 0 to 1."]
    parts += [f"Kinds of entities: {', '.join(entity_types)}."] if entity_types else []
    parts += [f"Types of relations: {', '.join(rel_types)}."] if rel_types else []
    parts += [known, "Add only what is missing above."] if known else []
    return "\n\n".join([*parts, f"Text:\n{text}"])


def entity_refs(names: DataFrame) -> DataFrame:
    """(id, name): one reference per name (name); the first in order of equal ids."""
    key = F.concat(F.lit("derived:entity:"), F.array_join(F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: w != ""), "_"))
    return names.select(key.alias("id"), "name").groupBy("id").agg(F.min("name").alias("name"))


def derived_edges(edges: DataFrame) -> DataFrame:
    """(id, first): edges (source, target, rel_type, seq) once per ``source__type__target``, the first to come."""
    return edges.groupBy(F.concat_ws("__", "source", "rel_type", "target").alias("id")).agg(F.min("seq").alias("first"))


def subqueries(found: DataFrame, most: int = 8) -> DataFrame:
    """(question_id, ord, subquery): the first candidates (question_id, name, rank) in two halves, each asked how it hangs together; a single one, how it bears on the question."""
    names = found.where(F.col("rank") <= most).groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("names"))
    half = F.floor(F.size("names") / 2).cast("int")
    asked = lambda part: F.concat(F.lit("How do "), F.array_join(part, ", "), F.lit(" relate to each other?"))
    one = F.array(F.concat(F.lit("How does "), F.element_at("names", 1), F.lit(" relate to the question?")))
    two = F.array(asked(F.slice("names", F.lit(1), half)), asked(F.slice("names", half + 1, F.size("names"))))
    rows = names.select("question_id", F.posexplode(F.when(F.size("names") == 1, one).otherwise(two)).alias("ord", "subquery"))
    return rows.select("question_id", "ord", "subquery")
