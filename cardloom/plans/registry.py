"""Queries over the given tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from . import card_queries, contact_queries, page_queries, source_queries

MODULES = (contact_queries, page_queries, card_queries, source_queries)


def queries():
    return {n: q for m in MODULES for n, (q, _) in m.QUERIES.items()}


def oracle_sql():
    return {n: s for m in MODULES for n, (_, s) in m.QUERIES.items() if s}
