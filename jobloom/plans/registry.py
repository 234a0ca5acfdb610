"""All registered queries of the reference operators and their SQL."""

from __future__ import annotations

from . import ORACLE, QUERIES, boards, evidence, matching, overlays, pages, sources, text, training


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


__all__ = ["boards", "evidence", "matching", "overlays", "pages", "sources", "text", "training"]
