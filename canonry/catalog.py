"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from .plans import case_queries, election_queries, engine_queries, heading_queries, label_queries, panel_queries, planning_queries, rule_queries, sync_queries, table_queries, text_queries

_ALL = rule_queries.QUERIES | table_queries.QUERIES | text_queries.QUERIES | label_queries.QUERIES | case_queries.QUERIES | engine_queries.QUERIES | panel_queries.QUERIES | heading_queries.QUERIES | planning_queries.QUERIES | election_queries.QUERIES | sync_queries.QUERIES


def flagship(spark, sf_dir):
    return rule_queries.q01_order_scores(spark, sf_dir)


def queries() -> dict:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
