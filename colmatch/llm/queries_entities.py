"""Queries of problem 5: the same columns in two catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.llm.entities import match_columns
from colmatch.plans.shared import table


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching rows of both catalogues with the confidence of each match."""
    side = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), "table_name", "name", "data_type", "samples")
    return match_columns(side("catalog_left", "left_id"), side("catalog_right", "right_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching rows of both catalogues."""
    return p5_matches(spark, sf_dir).select("left_id", "right_id")


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches}
SQL: dict[str, str] = {}
