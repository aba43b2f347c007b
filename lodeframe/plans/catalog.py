"""The registry of named queries: one module of lodeframe.plans for each operator family."""

from __future__ import annotations

from lodeframe.plans import admission, contracts, evidence, forms, lifecycle, scores

MODULES = [scores, admission, evidence, lifecycle, forms, contracts]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark, sf_dir):
    """Interval scores, soft ratio and composite of every unit."""
    return scores.g_composite(spark, sf_dir)
