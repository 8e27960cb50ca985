"""All queries of this package, and the SQL of those that have one."""

from __future__ import annotations

from corpusmill.llm import clusters, distinctive, frequency, languages, lookalikes, mixture, neighbours, scans, tokens

MODULES = (distinctive, scans, clusters, neighbours, lookalikes, frequency, tokens, mixture, languages)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
