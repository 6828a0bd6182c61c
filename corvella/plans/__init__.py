"""Registered queries: each a DataFrame plan with its DuckDB SQL."""

from __future__ import annotations


def registered() -> dict[str, tuple]:
    """name -> (query, SQL or None)."""
    from . import checks, corpus, extras, retrieval, search, snapshots, usage

    modules = (retrieval, search, snapshots, usage, checks, extras, corpus)
    return {name: (query, m.ORACLE_SQL.get(name)) for m in modules for name, query in m.QUERIES.items()}
