"""Queries of the core, by name, with their SQL."""

from __future__ import annotations

from countlake.plans import geometry_queries, matrix_queries, problems, source_queries


def queries() -> dict:
    return matrix_queries.QUERIES | geometry_queries.QUERIES | source_queries.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return matrix_queries.ORACLE | geometry_queries.ORACLE | source_queries.ORACLE | problems.oracle_sql()
