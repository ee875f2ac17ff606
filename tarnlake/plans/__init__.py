"""Registered queries of the library, with their SQL."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries of the base library by name, and their SQL."""
    from . import adapters, collections, guards, landing, nested, opinions, relations, reports, retries, scans, stored, texts

    queries, sql = opinions.QUERIES | collections.QUERIES, opinions.SQL | collections.SQL
    for module in (texts, landing, relations, guards, nested, stored, retries, reports, adapters, scans):
        assert not queries.keys() & module.query.queries.keys(), "a query is registered twice"
        queries |= module.query.queries
        sql |= module.query.sql
    return queries, sql
