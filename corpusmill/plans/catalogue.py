"""Catalogue of queries over the project's tables, with the SQL that says the same."""

from __future__ import annotations

from corpusmill.plans import analysis, corpus, essays
from corpusmill.plans.corpus import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

_PARTS = [corpus, essays, analysis]


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.Q_.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.SQL.items()}
