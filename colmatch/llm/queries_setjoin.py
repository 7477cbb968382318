"""Queries of problem 6: Fields with strongly overlapping value sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.llm.setjoin import similar_rows
from colmatch.plans.shared import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Fields of different tables with Jaccard >= 0.6."""
    found = similar_rows(table(spark, sf_dir, "field_profiles"), "field_id", "table_name", "samples")
    return found.select(F.col("a").alias("field_id_a"), F.col("b").alias("field_id_b"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": r"""
        WITH v AS (
          SELECT DISTINCT field_id, table_name, lower(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS val
          FROM (SELECT field_id, table_name, unnest(samples) AS s FROM field_profiles) WHERE s IS NOT NULL),
        s AS (SELECT field_id, table_name, val, count(*) OVER (PARTITION BY field_id) AS n FROM v WHERE val <> ''),
        p AS (SELECT a.field_id AS field_id_a, b.field_id AS field_id_b, a.n AS na, b.n AS nb, count(*) AS o
              FROM s a JOIN s b ON a.val = b.val AND a.field_id < b.field_id AND a.table_name IS DISTINCT FROM b.table_name
              WHERE a.n >= 3 AND b.n >= 3 GROUP BY ALL)
        SELECT field_id_a, field_id_b FROM p WHERE o * 8 >= 3 * (na + nb)""",
}
