"""SQL that recomputes registered queries independently, on the same sample tables."""

from threatloom.sources.sample_views import sql_for_check

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def ask(views: str, body: str) -> str:
    """Full SQL: the input views as CTEs, then ``body`` (a SELECT, or more CTEs and a SELECT)."""
    parts = [f"v_{name} AS MATERIALIZED ({sql_for_check(name)})" for name in views.split()]
    body = body.strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH RECURSIVE " + ",\n".join(parts) + joiner + body


RANK = "CASE {0} WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 WHEN 'info' THEN 1 ELSE 0 END"
