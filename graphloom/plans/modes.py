"""Question answering over a knowledge graph and its chunks: vector, keyword-driven and graph-driven modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import prompts, text, udfs
from graphloom.operators import aggregates, analytics, graph, knn, lookups, mentions, traverse
from graphloom.sources import descriptions, tables

RESULT = "response string, entities_used array<string>, relationships_used array<string>, mode string"
_NAMES = {"entity-first": "local ent entity entity-first", "relationship-first": "rel relationship relationship-first", "hybrid": "hyb hybrid", "mix": "mix"}
MODES = {name: mode for mode, names in _NAMES.items() for name in names.split()}
ENTITY_BUDGET, RELATION_BUDGET, CHUNK_BUDGET = 6_000, 8_000, 30_000


def echo(question: str, context: str) -> str:
    """The default answerer: the context itself. Pass another to call a language model."""
    return context


@dataclass
class Engine:
    """Tables of one collection, and the plug-ins."""

    entities: DataFrame
    aliases: DataFrame
    named: DataFrame
    chunks: DataFrame
    entity_notes: DataFrame | None = None  # (entity_id, description, weight, document_id); without them a type describes its entities
    relation_notes: DataFrame | None = None  # (rel_id, description, weight, document_id); without them keywords describe a relation
    embed: Callable[[str], list[float]] = field(default=lambda t: udfs.embed(t).tolist())
    answer: Callable[[str, str], str] = echo
    _stored: bool = field(default=False, init=False, repr=False)

    def __post_init__(self) -> None:
        plain = lambda rows, key, name, told: rows.select(F.col(key).alias(name), told.alias("description"), F.lit(1).alias("weight"), F.lit(None).cast("bigint").alias("document_id"))
        if self.entity_notes is None:
            self.entity_notes = plain(self.entities, "id", "entity_id", F.lower("primary_type"))
        if self.relation_notes is None:
            self.relation_notes = plain(self.named, "rel_id", "rel_id", F.array_join("keywords", ", "))

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(tables.entities(spark, sf_dir), tables.entity_aliases(spark, sf_dir), tables.named_relations(spark, sf_dir), tables.chunks(spark, sf_dir), descriptions.entity_descriptions(spark, sf_dir), descriptions.relation_descriptions(spark, sf_dir))

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def _one(self, column) -> object:
        return self.spark.range(1).select(column).first()[0]

    # vector search
    def chunk_hits(self, question: str, k: int = 5) -> DataFrame:
        return knn.top_texts(self.chunks, self.embed(question), k, "document_id", "content").select("document_id", "content", "score")

    def entity_hits(self, question: str, k: int = 20) -> DataFrame:
        return knn.top_texts(self.entities, self.embed(question), k, "id", "name").select("id", "name", "primary_type", "score")

    def mentioned(self, question: str, limit: int = 20) -> DataFrame:
        asked = self.spark.createDataFrame([("q", question)], "question_id string, question string")
        runs = [r.key for r in mentions.runs(asked).collect()]
        return mentions.find(asked, mentions.index(self.entities, self.aliases, runs), limit)

    def candidates(self, question: str, k: int = 50) -> DataFrame:
        """(id, name, score): mentioned entities first, then the nearest, one per name."""
        named = self.mentioned(question).select(F.col("entity_id").alias("id"), "name", "score", F.lit(0).alias("source"))
        near = self.entity_hits(question, k).select("id", "name", "score", F.lit(1).alias("source"))
        once = aggregates.top_per(named.unionByName(near), ["name"], [F.col("source"), F.desc("score"), F.col("id")], 1)
        return once.orderBy("source", F.desc("score"), "id").select("id", "name", "score").limit(k)

    def scored(self, question: str, *more: str, narrow: bool = False) -> DataFrame:
        """All relations with similarity and combined score, stored once per question, however often a traversal asks. The tokens of ``more`` questions count too.

        What is stored for the first question is also where relations are read from after it;
        ``narrow`` then stores only what seeds and beams need.
        """
        tokens = sorted({t for q in (question, *more) for t in self._one(text.query_tokens(F.lit(q)))})
        query = self.embed(self._one(text.relation_query(F.lit(question))))
        rows = traverse.score_edges(self.named, query, tokens)
        if self._stored:
            return analytics.stored(rows.select("rel_id", "src", "dst", "rel_type", "sim", "combined") if narrow else rows)
        rows = analytics.stored(rows)
        self.named, self._stored = rows.drop("sim", "combined"), True
        return rows

    def relation_seeds(self, scored: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
        return scored.where(F.col("sim") >= least).orderBy(F.desc("sim"), "rel_id").limit(k)

    # states
    def entity_first(self, question: str, scored: DataFrame | None = None) -> traverse.State:
        scored = self.scored(question) if scored is None else scored
        seeds = {r.id: float(r.score or 0.0) for r in self.candidates(question, 20).collect()}
        least, energy = traverse.thresholds(max(seeds.values(), default=0.0))
        near = {}
        for r in self.relation_seeds(scored, 50, least).select("src", "dst", "sim").collect():
            near[r.src], near[r.dst] = max(near.get(r.src, 0.0), r.sim), max(near.get(r.dst, 0.0), r.sim)
        return traverse.energy_first(traverse.Neighbourhoods(scored, least), seeds, near, energy)

    def seeded(self, scored: DataFrame, ends: int, pairs: int) -> traverse.State:
        seeds = [(r.rel_id, r.src, r.dst, r.combined) for r in self.relation_seeds(scored).collect()]
        return traverse.seed_pairs(traverse.Neighbourhoods(scored), seeds, ends, pairs)

    def filtered(self, question: str, state: traverse.State, least: float = 0.0) -> traverse.State:
        """A state's entities that score enough as candidates of the question (0 if they aren't), with its relations inside them and all other relations between them."""
        if not state.relevance:
            return state
        score = {}
        for r in self.candidates(question).collect():
            score.setdefault(r["name"].strip().lower(), float(r.score or 0.0))
        found = self.spark.createDataFrame([(n,) for n in sorted(state.relevance)], "id string")
        names = {r.id: r["name"].strip().lower() for r in self.entities.join(F.broadcast(found), "id", "left_semi").collect()}
        kept = {i: max(state.relevance[i], score.get(n, 0.0)) for i, n in names.items() if score.get(n, 0.0) >= least}
        out = traverse.State(kept)
        if not kept:
            return out
        nodes = self.spark.createDataFrame([(n,) for n in sorted(kept)], "node string")
        induced = sorted(r.rel_id for r in graph.inside(self.named, F.broadcast(nodes)).select("rel_id").collect())
        known = set(induced)
        own = [r for r in state.relations if r in known]
        for r in [*own, *[r for r in induced if r not in set(own)]]:
            out.cross(r)
            out.scores[r] = state.scores.get(r, 0.0)
        out.relations.sort(key=lambda r: -out.scores[r])
        return out

    def relationship_first(self, question: str, scored: DataFrame | None = None, ends: int = 30, pairs: int = 40) -> traverse.State:
        scored = self.scored(question) if scored is None else scored
        return self.filtered(question, self.seeded(scored, ends, pairs))

    def anchors(self, question: str, scored: DataFrame | None = None, names: list[str] | None = None) -> traverse.State:
        """Entities of some names (by default those that the question mentions) and their 40 heaviest relations."""
        scored = self.scored(question) if scored is None else scored
        if names is None:
            state = traverse.State({r.entity_id: r.score for r in self.mentioned(question).collect()})
        else:
            wanted = self.spark.createDataFrame([(n,) for n in names], "name string")
            state = traverse.State({r.entity_id: 1.0 for r in lookups.name_variants(wanted, self.entities, self.aliases).collect()})
        nodes = self.spark.createDataFrame([(n,) for n in state.relevance], "node string")
        tokens = F.lit(self._one(text.query_tokens(F.lit(question))))
        for r in traverse.limited(scored.drop("combined"), nodes, 0.95, 40, tokens).collect():
            state.cross(r.rel_id)
            state.scores[r.rel_id] = r.combined
            state.meet(r.src, r.combined)
            state.meet(r.dst, r.combined)
        return state

    def subqueries(self, names: list[str]) -> list[str]:
        """Questions about the first eight candidates, in two halves."""
        rows = self.spark.createDataFrame([("q", n, i + 1) for i, n in enumerate(names[:8])], "question_id string, name string, rank int")
        return [r.subquery for r in prompts.subqueries(rows).orderBy("ord").collect()]

    def mixed(self, question: str, scored: DataFrame) -> list[traverse.State]:
        """Relation seeds; and if the best candidate reaches 0.3, the anchors of the first eight and a state for each question about them."""
        states = [self.filtered(question, self.seeded(scored, 30, 40))]
        found = [(r["name"], r.score) for r in self.candidates(question).collect()]
        if not found or (found[0][1] or 0.0) < 0.3:
            return states
        names = [n for n, _ in found[:8]]
        states.append(self.anchors(question, scored, names))
        for asked in self.subqueries(names):
            states.append(self.filtered(asked, self.seeded(self.scored(asked, question, narrow=True), 20, 30)))
        return states

    def merged(self, *states: traverse.State) -> tuple[DataFrame, DataFrame]:
        frames = [s.frames(self.spark) for s in states]
        return aggregates.merge_entity_states([f[0] for f in frames]), aggregates.merge_relation_states([f[1] for f in frames])

    def state(self, question: str, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, entity_id, relevance) and (query_id, rel_id, combined, ord)."""
        mode = MODES.get((mode or "mix").lower(), "mix")
        scored = self.scored(question)
        if mode == "entity-first":
            return self.merged(self.entity_first(question, scored))
        if mode == "relationship-first":
            return self.merged(self.relationship_first(question, scored))
        if mode == "hybrid":
            return self.merged(self.entity_first(question, scored), self.relationship_first(question, scored))
        return self.merged(*self.mixed(question, scored))

    # answers
    def context(self, entities: DataFrame, relations: DataFrame, most_entities: int = 10, most_relations: int = 50) -> DataFrame:
        """(kind, section, key, ord, line): the best entities with four descriptions each, then relations by type, the best type first, a line per description."""
        best = lambda rows, key: aggregates.top_per(rows, [key], [F.desc("weight"), F.col("description"), F.col("document_id")], 4, "_d")
        e = entities.orderBy(F.desc("relevance"), "entity_id").limit(most_entities).join(self.entities, F.col("entity_id") == F.col("id"))
        notes = best(lookups.by_keys(self.entity_notes, e.select("entity_id"), "entity_id"), "entity_id").groupBy("entity_id")
        notes = notes.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_d", "description"))), lambda x: x["description"]), " | ").alias("told"))
        line = F.concat("name", F.lit(" ("), F.coalesce("primary_type", F.lit("unknown")), F.lit("): "), "told")
        e = e.join(notes, "entity_id").select(F.lit("entity").alias("kind"), F.lit(1.0).alias("section"), "relevance", F.col("id").alias("key"), F.lit(0).alias("_d"), line.alias("line"))
        r = relations.orderBy("ord").limit(most_relations).join(self.named.drop("weight"), "rel_id")
        r = r.join(best(lookups.by_keys(self.relation_notes, r.select("rel_id"), "rel_id"), "rel_id"), "rel_id")
        section = F.max("combined").over(aggregates.Window.partitionBy("rel_type"))
        line = F.concat("source_name", F.lit(" -["), "rel_type", F.lit("]-> "), "target_name", F.lit(": "), "description")
        r = r.select(F.lit("relation").alias("kind"), section.alias("section"), F.col("combined").alias("relevance"), F.col("rel_id").alias("key"), "_d", line.alias("line"))
        order = aggregates.Window.partitionBy("kind").orderBy(F.desc("section"), F.desc("relevance"), "key", "_d")
        return e.unionByName(r).withColumn("ord", F.row_number().over(order)).drop("_d")

    def _result(self, question: str, lines: list[str], entities: list[str], relations: list[str], mode: str) -> DataFrame:
        return self.spark.createDataFrame([(self.answer(question, "\n\n".join(lines)), entities, relations, mode)], RESULT)

    def graph_query(self, question: str, mode: str | None = None) -> DataFrame:
        rows = self.context(*self.state(question, mode)).orderBy("kind", "ord").collect()
        return self._result(question, [r.line for r in rows], [r.key for r in rows if r.kind == "entity"], list(dict.fromkeys(r.key for r in rows if r.kind == "relation")), MODES.get((mode or "mix").lower(), "mix"))

    def vector_query(self, question: str) -> DataFrame:
        """The nearest five chunks; without a language model the first of them is the answer."""
        rows = self.chunk_hits(question).collect()
        context = rows[0].content if self.answer is echo and rows else "\n\n".join(r.content for r in rows)
        return self._result(question, [context] if rows else [], [], [], "vector")

    def keywords(self, question: str) -> str:
        return " ".join(self._one(text.fallback_keywords(F.lit(question)))) or question

    def _budget(self, rows: DataFrame, order: list, content: str, key: str, budget: int) -> tuple[list[str], list[str]]:
        kept = aggregates.budgeted(rows.withColumn("_g", F.lit(0)), ["_g"], order, content, budget).orderBy(*order).collect()
        return [r.shown for r in kept], [r[key] for r in kept if r.whole]

    def _sources(self, entities: DataFrame, relations: DataFrame) -> list[str]:
        """Chunks that describe some entities (entity_id) or relations (rel_id), within the budget."""
        ids = lookups.by_keys(self.entity_notes, entities, "entity_id").select("document_id").unionByName(lookups.by_keys(self.relation_notes, relations, "rel_id").select("document_id"))
        rows = lookups.by_keys(self.chunks, ids, "document_id")
        order = [F.col(c) for c in ("chunk_index", "document_id") if c in rows.columns]
        return self._budget(rows, order, "content", "document_id", CHUNK_BUDGET)[0]

    def light_local(self, question: str) -> tuple[list[str], list[str], list[str]]:
        """The twenty nearest entities, their relations, the chunks behind both: each within its budget of words."""
        hits = analytics.cut(self.entity_hits(self.keywords(question)))
        lines, ids = self._budget(hits.withColumn("line", text.format_entity(F.col("name"), F.col("primary_type"))), [F.desc("score"), F.col("id")], "line", "id", ENTITY_BUDGET)
        edges = graph.touching(self.named, hits.select(F.col("id").alias("node")))
        edges = edges.withColumn("line", text.format_relation(F.col("source_name"), F.col("target_name"), F.lower("rel_type"), F.col("keywords")))
        # a line is a word at least, so no row beyond the budget's number of words can be shown
        edges = analytics.cut(edges.orderBy(F.desc("weight"), "rel_id").limit(RELATION_BUDGET))
        more, rels = self._budget(edges, [F.desc("weight"), F.col("rel_id")], "line", "rel_id", RELATION_BUDGET)
        return lines + more + self._sources(hits.select(F.col("id").alias("entity_id")), edges), ids, rels

    def light_global(self, question: str) -> tuple[list[str], list[str], list[str]]:
        """The thirty nearest relations, their ends, and the chunks behind both."""
        seeds = analytics.cut(self.relation_seeds(self.scored(self.keywords(question)), 30, -1.0))
        rows = seeds.withColumn("line", text.format_relation(F.col("source_name"), F.col("target_name"), F.lower("rel_type"), F.col("keywords")))
        lines, rels = self._budget(rows, [F.desc("sim"), F.col("rel_id")], "line", "rel_id", RELATION_BUDGET)
        ends = [x for r in seeds.orderBy(F.desc("sim"), "rel_id").collect() for x in (r.src, r.dst)]
        chunks = self._sources(seeds.select(F.explode(F.array("src", "dst")).alias("entity_id")), seeds)
        return lines + chunks, list(dict.fromkeys(ends)), rels

    def light_query(self, question: str, mode: str = "local") -> DataFrame:
        """local, global, hybrid, naive or mix; anything else is local."""
        if mode == "naive":
            rows = self.chunk_hits(question).collect()
            return self._result(question, [r.content for r in rows], [], [], mode)
        if mode == "global":
            return self._result(question, *self.light_global(question), mode)
        lines, ids, rels = self.light_local(question)
        if mode in ("hybrid", "mix"):
            _, more_ids, more_rels = self.light_global(question)
            ids, rels = list(dict.fromkeys([*ids, *more_ids])), list(dict.fromkeys([*rels, *more_rels]))
        return self._result(question, lines, ids, rels, mode if mode in ("hybrid", "mix") else "local")

    def query(self, question: str, strategy: str = "custom_graph_rag", mode: str | None = None) -> DataFrame:
        """The entry point: the strategy of the collection picks the family of modes."""
        if strategy == "vector":
            return self.vector_query(question)
        return self.light_query(question, mode or "local") if strategy == "light_rag" else self.graph_query(question, mode)
