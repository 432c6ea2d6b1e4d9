"""Registered queries of the library proper, with their SQL."""

from __future__ import annotations

from .plans import features, members, places, requests, scenes, shapes

GROUPS = (features, members, places, requests, scenes, shapes)


def queries() -> dict:
    return {name: f for g in GROUPS for name, f in g.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.SQL.items()}
