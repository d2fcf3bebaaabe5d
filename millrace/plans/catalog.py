"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import dedup_queries, example_queries, extra_queries, io_queries, policy_queries, program_queries, report_queries, select_queries

MODULES = [policy_queries, dedup_queries, select_queries, report_queries, example_queries, extra_queries, program_queries, io_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
