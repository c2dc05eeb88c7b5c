"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from attestra.plans import retrieval_queries, rule_queries, table_queries, text_queries
from attestra.plans.registry import Query

REGISTRIES = (table_queries.R, text_queries.R, retrieval_queries.R, rule_queries.R)


def queries() -> dict[str, Query]:
    return {name: query for r in REGISTRIES for name, query in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
