"""Ingestion, relation types and traversals against plain Python on small fixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.functions import udfs
from graphloom.operators import analytics, ingest, reltypes, traverse


def model():
    """Pairs ``a>b`` of a text are its relations. A function of its own, so that it goes to the workers by value."""
    import json

    def read(content: str, known: list) -> str:
        pairs = [] if known else [p.split(">") for p in content.split() if ">" in p]
        return json.dumps({"relationships": [{"source": {"name": a, "description": f"{a}!"}, "target": b, "rel_type": "uses", "weight": 0.5, "keywords": [a]} for a, b in pairs]})

    return read


TEXTS = ["ann>bob bob>carl", "Ann>bob", "nothing here", "ann>bob bob>carl", "", "dora>ANN"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(str(i), t, f"/docs/./{i}" if i else None, 0) for i, t in enumerate(TEXTS)]
    from pyspark.sql import functions as F

    return ingest.identified(spark.createDataFrame(rows, "chunk_id string, text string, path string, chunk_index int"), F.lit("00000000-0000-4000-8000-000000000001"))


def test_documents_are_identified_by_path_then_by_chunk(chunks):
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert rows["1"].path == "/docs/1" and rows["0"].path is None
    assert rows["0"].chunk_hash == rows["3"].chunk_hash and rows["0"].document_id != rows["3"].document_id


def test_ingest_graph(chunks):
    nodes, edges = ingest.graph_rows(ingest.triples(chunks, model()))
    assert {r["name"].title() for r in nodes.collect()} == {"Ann", "Bob", "Carl", "Dora"}
    got = {frozenset((r.a.title(), r.b.title())): r.weight for r in edges.collect()}
    # equal contents count once; weights are tenths and add up
    assert got == {frozenset(("Ann", "Bob")): 10, frozenset(("Bob", "Carl")): 5, frozenset(("Dora", "Ann")): 5}


def test_ingest_by_name(chunks):
    nodes, edges = ingest.named_rows(ingest.triples(chunks, model()))
    got = {r["name"]: (r.description, len(r.source_ids)) for r in nodes.collect()}
    assert set(got) == {"ann", "Ann", "bob", "carl", "dora", "ANN"}
    assert got["bob"] == ("bob!", 2)
    assert {(r.source, r.target) for r in edges.collect()} == {("ann", "bob"), ("bob", "carl"), ("Ann", "bob"), ("dora", "ANN")}


def test_ledger_has_a_row_of_every_chunk(chunks):
    rows = {r.chunk_id: r for r in ingest.ledger(chunks, "light_rag", ingest.triples(chunks, model())).collect()}
    assert [rows[str(i)].relationship_count for i in range(6)] == [2, 1, 0, 2, 0, 1]
    assert [rows[str(i)].entity_count for i in range(6)] == [3, 2, 0, 3, 0, 2]


def test_descriptions_are_one_per_document(spark):
    seen = spark.createDataFrame([(1, 7, 1, "a", "h1"), (1, 7, 2, "b", "h2"), (1, 7, 3, "c", "h1"), (1, None, 4, "d", "h3"), (1, None, 5, "d", "h3")], "rel_id int, document_id int, seq int, description string, chunk_hash string")
    old = spark.createDataFrame([(1, 8, "old", 2, ["h0"])], "rel_id int, document_id int, description string, weight bigint, hashes array<string>")
    rows = sorted((r.document_id or 0, r.description, r.weight, r.hashes) for r in ingest.described(old, seen).collect())
    assert rows == [(0, "d", 1, ["h3"]), (0, "d", 1, ["h3"]), (7, "a", 3, ["h1", "h2"]), (8, "old", 2, ["h0"])]


def test_types_are_learnt_in_order(spark):
    labels = ["USES", "uses", "IS PART OF", "PART_OF", "IS_PART_OF", "PART_OF", "PART_OF", "IS_PART_OF"]
    rows = reltypes.resolved_types(spark.createDataFrame([("c", i, x) for i, x in enumerate(labels)], "collection_id string, seq int, rel_type string"), high=0.8).orderBy("seq").collect()
    assert [r.how for r in rows] == ["new", "known", "new", "alike", "known", "known", "known", "known"]
    # frequencies of IS_PART_OF: 2 3 3 3 3 4; of PART_OF: 0 2 2 3 4 4; ties go to the first in the alphabet
    assert [r.canonical_type for r in rows[2:]] == ["IS_PART_OF", "IS_PART_OF", "IS_PART_OF", "IS_PART_OF", "PART_OF", "IS_PART_OF"]


def test_clusters_of_types_against_all_pairs(spark):
    names = ["HAS_PART", "HAS_PARTS", "PART", "A_PART", "OF_A_PART", "USES", "USES_X", "NEAR"]
    counts = spark.createDataFrame([(n, i % 3 + 1) for i, n in enumerate(names)], "rel_type string, n int")
    vector = {n: udfs.embed(n.lower().replace("_", " ")) for n in names}
    group = {n: {n} for n in names}
    for a in names:
        for b in names:
            if a != b and round(float(vector[a] @ vector[b]), 6) >= 0.7 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    number = {n: i % 3 + 1 for i, n in enumerate(names)}
    got = {r.rel_type: r.representative for r in reltypes.clustered(counts, 0.7).collect()}
    assert got == {n: max(group[n], key=lambda x: (number[x], x)) for n in names}


def test_prefix_filter_loses_no_pair(spark):
    """Role similarity over random sets with hubs against all pairs."""
    rng = random.Random(8)
    sets = {f"n{i:02d}": {f"t{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randrange(1, 30))} for i in range(60)}
    tokens = spark.createDataFrame([(n, t) for n, s in sets.items() for t in s], "n string, token string")
    got = {(r.a, r.b): (r.overlap, r.cosine, r.jaccard) for r in analytics.similar(tokens, 2, 0.2, 0.1, 1).collect()}
    want = {}
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            c, j = o / (len(sets[a]) * len(sets[b])) ** 0.5, o / len(sets[a] | sets[b])
            if a < b and o >= 2 and c >= 0.2 and j >= 0.1:
                want[a, b] = (o, round(c, 6), round(j, 6))
    assert got == want


def test_neighbourhoods_keep_neighbours_behind_parallel_edges(spark):
    """A node with hundreds of parallel edges to one neighbour still shows the others."""
    rows = [(f"p{i:04d}", "a", "hub", "T", 0.9) for i in range(500)] + [(f"q{i}", "a", f"z{i}", "T", 0.1) for i in range(5)]
    scored = spark.createDataFrame(rows, "rel_id string, src string, dst string, rel_type string, combined double")
    near = traverse.Neighbourhoods(scored)
    near.fetch(["a"])
    assert {e[1] for e in near["a"]} == {"hub", *[f"z{i}" for i in range(5)]}
    assert sum(e[1] == "hub" for e in near["a"]) == traverse.STEPS


def test_dimension_scores(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(12, 4)), rng.normal(size=(2, 4))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "rel_id int, embedding array<double>")
    asked = spark.createDataFrame([(f"T{i}", v) for i, v in enumerate(q.tolist())], "rel_type string, query array<double>")
    got = {r.rel_type: r.score for r in reltypes.dimension_scores(vectors, asked).collect()}
    for i in range(2):
        best = np.sort((x @ q[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i]))[::-1][:3]
        assert got[f"T{i}"] == pytest.approx(best[0] + best.mean(), abs=2e-6)
