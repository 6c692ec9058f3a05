"""All registered queries of the core."""

from __future__ import annotations

from lorewell.plans import activity, general, knowledge, transcripts

MODULES = [activity, knowledge, transcripts, general]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
