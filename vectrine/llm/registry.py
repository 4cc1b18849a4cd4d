"""The queries of this subpackage, one module for each operator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "near_dedup",
    "quality_rules",
    "license_scan",
    "language_id",
    "quality_model",
    "toxicity",
    "mixing",
    "packing",
    "sharding",
    "exact_topk",
    "pipeline"
)


def _modules() -> list:
    return [importlib.import_module(f"vectrine.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in _modules() for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
