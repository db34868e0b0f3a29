"""The named queries of the subpackage."""

from __future__ import annotations

from recordloom.llm import p02_names, p03_conversations, p04_pii, p05_pairs, p07_entities, p08_leaks, p09_mixing, p10_endings

MODULES = [p02_names, p03_conversations, p04_pii, p05_pairs, p07_entities, p08_leaks, p09_mixing, p10_endings]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
