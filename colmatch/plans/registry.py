"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colmatch.plans import matching, prepared, scalar

_MODULES = [matching, scalar, prepared]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.jaccard_exact(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
