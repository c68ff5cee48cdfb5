"""Whole analyses, and the catalog of runnable queries."""

from __future__ import annotations

from importlib import import_module


def load_catalog():
    """Queries and SQL of all catalog modules."""
    from taxaflow.plans.catalog import QUERIES, SQL

    for module in ("record_queries", "explore_queries", "draw_queries", "model_queries"):
        import_module(f"taxaflow.plans.{module}")
    return dict(QUERIES), dict(SQL)
