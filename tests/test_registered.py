"""Registered queries without SQL, at their own parameters, against plain Python on a small folder of tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from graphloom import queries
from graphloom.sources import tables


def _folder(folder, suppliers, lines):
    """One region, nation, customer and order; ``lines`` are (part, supplier)."""
    parts = sorted({p for p, _ in lines})
    rows = {
        "region": pd.DataFrame({"r_regionkey": [0], "r_name": "R"}),
        "nation": pd.DataFrame({"n_nationkey": [0], "n_name": "N", "n_regionkey": 0}),
        "customer": pd.DataFrame({"c_custkey": [1], "c_name": "C", "c_nationkey": 0, "c_mktsegment": "S"}),
        "supplier": pd.DataFrame({"s_suppkey": suppliers, "s_name": "S", "s_nationkey": 0}),
        "part": pd.DataFrame({"p_partkey": parts, "p_name": "small ring", "p_brand": "B", "p_type": "T"}),
        "orders": pd.DataFrame({"o_orderkey": [1], "o_custkey": 1, "o_orderpriority": "P"}),
        "lineitem": pd.DataFrame([(1, p, s) for p, s in lines], columns=["l_orderkey", "l_partkey", "l_suppkey"]),
    }
    for name, frame in rows.items():
        frame.to_parquet(folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return _folder(tmp_path_factory.mktemp("small"), [1], [(1, 1)])


@pytest.fixture(scope="module")
def weights(spark, small):
    """Nodes and the matrix of edge weights."""
    edges = tables.relations(spark, small).select("src", "dst", "weight").collect()
    nodes = sorted({v for e in edges for v in (e.src, e.dst)})
    w = np.zeros((len(nodes), len(nodes)))
    for e in edges:
        w[nodes.index(e.src), nodes.index(e.dst)] += max(e.weight, 1)
    return nodes, w


def _vector(rows, nodes, column):
    got = {r.id: r[column] for r in rows}
    assert got.keys() == set(nodes)
    return np.array([got[v] for v in nodes])


def test_pagerank_settles(spark, small, weights):
    nodes, w = weights
    out = w.sum(1)
    p = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    want = np.full(len(nodes), 1 / len(nodes))
    for _ in range(1000):
        want = 0.15 / len(nodes) + 0.85 * (want @ p + want[out == 0].sum() / len(nodes))
    got = _vector(queries.QUERIES["pagerank"](spark, small).collect(), nodes, "score")
    assert np.abs(got - want).sum() < 1e-7


def test_hits_settle(spark, small, weights):
    nodes, w = weights
    hub = np.ones(len(nodes))
    for _ in range(1000):
        authority = hub @ w
        authority /= np.linalg.norm(authority)
        hub = w @ authority
        hub /= np.linalg.norm(hub)
    rows = queries.QUERIES["hits"](spark, small).collect()
    assert np.abs(_vector(rows, nodes, "hub") - hub).sum() < 1e-6
    assert np.abs(_vector(rows, nodes, "authority") - authority).sum() < 1e-6


def test_eigenvector_settles(spark, small, weights):
    nodes, w = weights
    value, vector = np.linalg.eigh(w + w.T)
    want = np.abs(vector[:, value.argmax()])
    got = _vector(queries.QUERIES["eigenvector"](spark, small).collect(), nodes, "score")
    assert np.abs(got - want).sum() < 1e-6


def test_cliques_at_the_threshold_of_role_pairs(spark, tmp_path):
    """The suppliers share the nation and a part: a cosine of 0.25."""
    folder = _folder(tmp_path, [1, 2], [(p, 1) for p in range(1, 8)] + [(p, 2) for p in range(7, 14)])
    tokens = {}
    for e in tables.relations(spark, folder).collect():
        tokens.setdefault(e.src, set()).add(("out", e.dst))
        tokens.setdefault(e.dst, set()).add(("in", e.src))
    like = set()
    for a in tokens:
        for b in tokens:
            both = len(tokens[a] & tokens[b])
            if a != b and both >= 2 and both / math.sqrt(len(tokens[a]) * len(tokens[b])) >= 0.2 and both / len(tokens[a] | tokens[b]) >= 0.1:
                like.add((a, b))
    nodes = sorted({a for a, _ in like})
    every = ([v for i, v in enumerate(nodes) if m >> i & 1] for m in range(1, 1 << len(nodes)))
    full = [s for s in every if all(p in like for p in itertools.combinations(s, 2))]
    want = ["|".join(s) for s in full if not any(all((u, v) in like for u in s) for v in nodes if v not in s)]
    assert any("supplier:1|supplier:2" in s for s in want)
    assert sorted(r.members for r in queries.QUERIES["enumerate_cliques"](spark, folder).collect()) == sorted(want)
