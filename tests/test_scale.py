"""What a query reads, joins and sends grows with its input: shapes of plans, and results against plain Python."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import text, udfs
from graphloom.operators import analytics, extract, graph, lookups, mentions
from graphloom.plans import modes
from graphloom.sources import store, tables


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_split_a_text_once(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "x")], "k int, t string")
    found = rows.select("k", text.ngrams(F.col("t"), 2).alias("g"))
    assert {r.k: r.g for r in found.collect()} == {1: ["a", "b", "c", "a b", "b c"], 2: [], 3: [], 4: ["x"]}
    assert _plan(found).count("split(") == 1


def test_word_hits_join_the_shown_aliases_only(spark):
    asked = spark.createDataFrame([("q", "old ring"), ("p", "ring")], "question_id string, question string")
    entities = spark.createDataFrame([(f"e{i}", f"n{i}") for i in range(9)], "id string, name string")
    aliases = spark.createDataFrame([(f"e{8 - i}", f"ring {i}") for i in range(9)] + [("gone", "ring")], "entity_id string, alias_name string")
    found = lookups.word_hits(asked, entities, aliases, rows=2)
    assert sorted((r.question_id, r.keyword, r.entity_id, r["rank"]) for r in found.collect()) == [("p", "ring", "e7", 2), ("p", "ring", "e8", 1), ("q", "ring", "e7", 2), ("q", "ring", "e8", 1)]
    top, _, below = _plan(found).partition("Join Inner")
    assert "Window " in top and "Window " in below


def test_exact_hits_leave_the_join_as_they_are(spark):
    """Pairs with two keys in common come once, without a shuffle of all pairs."""
    asked = spark.createDataFrame([(1, "What is a ring?"), (1, "who is b?"), (2, "A ring"), (3, "nothing"), (4, None)], "question_id int, question string")
    entities = spark.createDataFrame([("x", "A Ring"), ("x", "B"), ("y", "b")], "id string, name string")
    aliases = spark.createDataFrame([("y", "a ring"), ("y", "B")], "entity_id string, alias_name string")
    notes = spark.createDataFrame([("x", f"d{i}", i, 1) for i in range(6)], "entity_id string, description string, weight int, document_id int")
    found = lookups.exact_hits(asked, entities, aliases)
    want = [(1, "x", "name"), (1, "y", "alias"), (1, "y", "name"), (2, "x", "name"), (2, "y", "alias")]
    assert sorted((r.question_id, r.entity_id, r.via) for r in found.collect()) == want
    assert "Aggregate" not in _plan(found).partition("Join Inner")[0]
    told = lookups.exact_hits(asked, entities, aliases, notes, 2)
    assert sorted((r.question_id, r.description, r["rank"]) for r in told.collect()) == [(1, "d4", 2), (1, "d5", 1), (2, "d4", 2), (2, "d5", 1)]
    assert "Window " not in _plan(told).partition("Join Inner")[0]


def test_triples_are_handed_over_in_small_batches(spark):
    """The triples of a batch of texts aren't gathered in a Python worker's memory."""
    n = extract.ROWS
    model = lambda content, known: json.dumps({"relationships": [] if known else [{"source": f"a{i}", "target": "b", "rel_type": "x"} for i in range(n)]})
    chunks = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: run))
    texts = pa.RecordBatch.from_pydict({"chunk_id": [str(i) for i in range(5)], "content": ["t"] * 5})
    found = [b.num_rows for b in extract.extracted(chunks, model)(iter([texts]))]
    assert sum(found) == 5 * n and max(found) <= n


def test_text_similarity_is_that_of_embeddings(spark):
    q = udfs.embed("old ring of brand 7").tolist()
    rows = spark.createDataFrame([("Old RING, ring",), ("",), (None,), ("brand 7 ß",), ("??",)], "t string")
    for query in (q, [1.0]):
        got = rows.select(udfs.text_similarity(F.col("t"), query).alias("a"), udfs.similarity(udfs.hash_embedding("t"), query).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_relations_are_joined_by_numbers(spark):
    """Ids and names are made after the joins; both ends of an edge come from one pass."""
    plan = _plan(tables.named_relations(spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("src" in j or "dst" in j or "id#" in j.replace("nationid", "") for j in joins)
    edges = tables.relations(spark, "/root/testdata/sf0.001")
    assert _plan(graph.node_degrees(edges)).count("lineitem") <= _plan(edges.groupBy("src").count()).count("lineitem")


def test_scored_relations_are_stored_without_vectors(spark):
    engine = modes.Engine.over(spark, "/root/testdata/sf0.001")
    scored = engine.scored("ring")
    assert "embedding" not in scored.columns and "parquet" in _plan(engine.named).lower()
    assert "Join" not in _plan(engine.named)
    assert engine.scored("bolt").columns == scored.columns
    again = engine.scored("ring", narrow=True)
    assert "weight" not in again.columns
    assert sorted(scored.select(*again.columns).collect()) == sorted(again.collect())


def test_mentions_drop_keys_nobody_asks_for(spark):
    entities = spark.createDataFrame([("a", "Old Ring"), ("b", "old ring"), ("c", "Bolt")], "id string, name string")
    aliases = spark.createDataFrame([("c", "old ring"), ("c", "nut"), ("a", "nut"), ("b", "gone")], "entity_id string, alias_name string")
    whole = [tuple(r) for r in mentions.index(entities, aliases).collect()]
    asked = [tuple(r) for r in mentions.index(entities, aliases, ["nut", "old ring"]).collect()]
    assert sorted(asked) == sorted(r for r in whole if r[0] in ("nut", "old ring"))


def test_tasks_stay_small(spark, tmp_path):
    """Partitions follow the size of the files, not the setting."""
    small = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    assert tables.slices(small) == 1 and tables.slices(big) == 3
    assert store.relabel(tables.relations(spark, "/root/testdata/sf0.1"), "SUPPLIES", "CONTAINS")._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3


def test_paths_of_a_component_arent_one_task(spark):
    """Breadth first from all nodes by joins: no task holds a whole component."""
    edges = analytics.local_edges(spark, [("a", "b"), ("b", "c"), ("a", "b"), ("c", "c"), ("b", "d"), ("c", "e"), ("d", "e")])
    near, between = analytics.harmonic(edges), analytics.betweenness(edges)
    assert "Pandas" not in _plan(near) + _plan(between)
    assert {r.id: round(r.score, 6) for r in near.collect()} == {"a": round(1 + 1 + 1 / 3, 6), "b": 2.5, "c": 1.0, "d": 1.0, "e": 0.0}
    # a-b is two paths; b stands between a and c, d, e; half of the paths to e lead through c, for a and for b
    assert {r.id: round(r.score * 12, 6) for r in between.collect()} == {"a": 0.0, "b": 3.0, "c": 1.0, "d": 1.0, "e": 0.0}


def test_rounds_move_numbers_to_edges_that_stay(spark):
    edges = analytics.local_edges(spark, [("a", "b"), ("b", "c"), ("a", "b")])
    nodes, w = analytics.numbered(edges)
    of = {r.k: r.id for r in nodes.collect()}
    assert sorted(of.values()) == ["a", "b", "c"]
    assert sorted((of[r.s], of[r.d], r.w, r.m) for r in w.collect()) == [("a", "b", 2.0, 2), ("b", "c", 1.0, 1)]
    x = nodes.selectExpr("k", "1.0D as x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = analytics._flow(analytics._spread(w, "s"), x, "d", "s")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 2  # of the nodes' numbers and of the sums


def test_pairs_that_cannot_reach_the_thresholds_are_not_counted_out(spark, monkeypatch):
    """Sets of 60 tokens that share a few shown ones aren't candidates; those that share enough are."""
    sets = {f"n{i}": {f"t{i}-{j}" for j in range(58)} | {"x", "y"} for i in range(6)} | {"m": {f"t0-{j}" for j in range(30)} | {f"m{j}" for j in range(30)}}
    tokens = spark.createDataFrame([(n, t) for n, ts in sets.items() for t in ts], "n string, token string")
    kept = []
    monkeypatch.setattr(analytics, "stored", lambda df, real=analytics.stored: kept.append(real(df)) or kept[-1])
    found = analytics.similar(tokens, 2, 0.2, 0.1, 1).collect()
    assert [(r.a, r.b, r.overlap, r.size_a, r.size_b) for r in found] == [("m", "n0", 30, 60, 60)]
    assert [df.count() for df in kept if {"a", "b"} <= set(df.columns)] == [1]
