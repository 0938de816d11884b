"""Registered queries over the given tables, one module per subject."""

from __future__ import annotations


def registry():
    """All queries and their SQL twins."""
    import importlib

    queries, oracle = {}, {}
    for name in ("quality", "temporal", "taxonomic", "spatial", "models", "sources"):
        mod = importlib.import_module(f"obsweave.queries.{name}")
        queries |= mod.QUERIES
        oracle |= mod.ORACLE
    return queries, oracle
