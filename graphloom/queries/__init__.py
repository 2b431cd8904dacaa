"""The registered queries of the library, with SQL where SQL can express them."""

from __future__ import annotations

from . import graphs, relational, scalar, services

MODULES = (relational, scalar, graphs, services)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
