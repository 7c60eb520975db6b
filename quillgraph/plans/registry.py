"""Names, callables and oracle SQL of the graph queries."""

from __future__ import annotations

from . import group_ab, group_cd, group_ef, group_g, group_h, group_i, group_j, group_k, group_l

GROUPS = (group_ab, group_cd, group_ef, group_g, group_h, group_i, group_j, group_k, group_l)


def queries() -> dict:
    return {name: fn for g in GROUPS for name, (fn, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
