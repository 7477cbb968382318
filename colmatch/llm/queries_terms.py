"""Queries of problem 4: distinctive terms of text Fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colmatch.llm.terms import heaviest_terms, term_weights
from colmatch.plans.shared import table


def _text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "field_profiles").where("data_type = 'text'").select("field_id", "samples")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest terms of each text Field by sqrt(tf) * ln(N / df)."""
    return heaviest_terms(term_weights(_text_fields(spark, sf_dir), "field_id", "samples", "tfidf"), "field_id").select("field_id", "term")


def p4_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of each text Field with the largest adjusted residuals."""
    return heaviest_terms(term_weights(_text_fields(spark, sf_dir), "field_id", "samples", "residual", 6), "field_id")


QUERIES = {"p4_found": p4_found, "p4_residuals": p4_residuals}

_COUNTS = """
        WITH tok AS (
          SELECT field_id, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS term
          FROM (SELECT field_id, unnest(samples) AS s FROM field_profiles WHERE data_type = 'text') WHERE s IS NOT NULL),
        tf AS (SELECT field_id, term, count(*) AS tf FROM tok GROUP BY ALL),
        per_term AS (SELECT term, count(*) AS df, sum(tf) AS term_total FROM tf GROUP BY term),
        per_row AS (SELECT field_id, sum(tf) AS row_total FROM tf GROUP BY field_id),
        sums AS (SELECT count(DISTINCT field_id) AS n_rows, sum(tf) AS n FROM tf),"""

SQL = {
    "p4_found": _COUNTS + """
        w AS (SELECT field_id, term, round(sqrt(tf) * ln(n_rows / df), 9) AS weight FROM tf JOIN per_term USING (term), sums)
        SELECT field_id, term FROM (
          SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY weight DESC, term) AS r FROM w WHERE weight > 0) WHERE r <= 3""",
    "p4_residuals": _COUNTS + """
        w AS (SELECT field_id, term, tf, round((tf - row_total / n * (term_total / n) * n) / sqrt(row_total / n * (term_total / n) * n)
                     / sqrt((1 - row_total / n) * (1 - term_total / n)), 6) AS weight
              FROM tf JOIN per_term USING (term) JOIN per_row USING (field_id), sums)
        SELECT field_id, term, tf, weight FROM (
          SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY weight DESC, term) AS r FROM w WHERE weight > 0) WHERE r <= 3""",
}
