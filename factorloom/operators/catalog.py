"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from factorloom.operators import analytics, costs, factor_queries, graphs, plugins, portfolio, runs, trees
from factorloom.sources import stores
from factorloom.streaming import events

MODULES = (factor_queries, analytics, runs, costs, portfolio, trees, graphs, stores, events, plugins)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracles().items()}
