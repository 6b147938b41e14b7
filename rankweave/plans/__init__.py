"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from rankweave.plans import retrieval, tables, text


def all_queries() -> dict:
    return {**text.QUERIES, **retrieval.QUERIES, **tables.QUERIES}


def all_oracles() -> dict:
    return {**text.ORACLES, **retrieval.ORACLES, **tables.ORACLES}
