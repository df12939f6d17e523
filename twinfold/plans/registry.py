"""Collects the queries and comparison SQL of every family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("literal_checks", "scoring", "spending", "structure", "boxes", "rows", "pages", "reading", "ruled", "scaffold", "streams", "sides", "evidence")


def _modules():
    return [importlib.import_module(f"twinfold.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        overlap = found.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.ORACLE)
    return found
