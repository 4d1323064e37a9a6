"""All registered queries."""

from __future__ import annotations

from queries import graph, learn, placement, relational

_MODULES = [relational, graph, learn, placement]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
