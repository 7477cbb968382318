"""Queries of problem 1: the best column pairs of every source column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.llm.topn import top_n_per_group
from colmatch.plans.shared import table

NAMES = ["source_table", "source_column", "target_table", "target_column"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best pairs of each (source_table, source_column)."""
    e = table(spark, sf_dir, "match_entries").select(*NAMES, "score")
    ok = F.col("score").between(0.0, 1.0) & ~F.isnan("score")
    for c in NAMES:
        ok = ok & (F.col(c) != "")
    return top_n_per_group(e.where(ok), NAMES[:2], NAMES[2:], "score", 5).select(*NAMES)


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
        WITH best AS (
          SELECT source_table, source_column, target_table, target_column, max(score) AS score
          FROM match_entries
          WHERE source_table <> '' AND source_column <> '' AND target_table <> '' AND target_column <> ''
            AND score IS NOT NULL AND NOT isnan(score) AND score >= 0 AND score <= 1
          GROUP BY ALL)
        SELECT source_table, source_column, target_table, target_column FROM (
          SELECT *, row_number() OVER (PARTITION BY source_table, source_column
                                       ORDER BY score DESC, target_table, target_column) AS r FROM best)
        WHERE r <= 5""",
}
