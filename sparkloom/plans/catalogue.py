"""Names, Spark plans and DuckDB oracles of all reference-side queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ratings", "runs", "profile", "selection", "curation", "signal", "text", "data", "spoken")


def _all(part: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"sparkloom.plans.{m}_queries"), part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
