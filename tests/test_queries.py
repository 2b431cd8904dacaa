"""Every registered query of the library: against its SQL, or that it runs, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from graphloom import queries
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"
#: Iterations until they settle, minutes each: test_registered runs them on a small graph.
SLOW = {"enumerate_cliques", "pagerank", "hits", "eigenvector"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in tables.NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{_glob(name)}'")
    return con


def _glob(name: str) -> str:
    path = f"{SF}/{name}.parquet"
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return round(x, 6)
    return x if isinstance(x, int) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - SLOW))
def test_runs(spark, name):
    """All of it is computed, though nothing is compared."""
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
