"""Registered queries: name, callable over (spark, sf_dir), and DuckDB SQL giving the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules below noteloom.plans that register queries.
MODULES: tuple[str, ...] = ("core", "linking", "review", "evaluation", "reports")


def _registered():
    return [importlib.import_module(f"noteloom.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _registered() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _registered() for k, s in m.ORACLES.items()}
