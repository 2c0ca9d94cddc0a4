"""Queries of this subpackage."""

from __future__ import annotations

from folioscan.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE)
