"""All queries of the library but those of the optional subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.plans import pages, upkeep

_MODULES = [upkeep, pages]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return pages.QUERIES["rank_multicol"](spark, folder)
