"""All registered queries of the core library, with the SQL each must equal."""

from __future__ import annotations

from lexwright.plans import edits, lookup, parsers, retrieve, statutes, texts, tree, versions

_MODULES = [lookup, tree, versions, texts, retrieve, statutes, parsers, edits]


def queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
