"""Named queries of the engine and the SQL that checks them."""

from __future__ import annotations

from . import eval_plans, graph_plans, search_plans, text_plans

_MODULES = (text_plans, graph_plans, eval_plans, search_plans)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
