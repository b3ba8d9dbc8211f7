"""All registered queries and their SQL."""

from __future__ import annotations

from rollbook.plans import (
    audit_queries, course_queries, file_queries, function_queries, list_queries, match_queries, report_queries, survey_queries,
)

MODULES = (
    file_queries, function_queries, list_queries, match_queries, report_queries, survey_queries, course_queries,
    audit_queries,
)


def queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for module in MODULES for name, q in module.SQL.items()}
