"""The named queries of the engine and, where SQL can say the same, their SQL."""

from __future__ import annotations

from recordloom.plans import comparison, details, history, lifecycle, normal, p01_references, p06_units, relational, retrieval, scalars, search
from recordloom.streaming import runs

MODULES = [p01_references, p06_units, relational, search, history, comparison, retrieval, lifecycle, normal, scalars, details, runs]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
