"""Queries of problem 9: languages of documents and stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colmatch.llm.language import identify
from colmatch.plans.shared import table


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lang_samples").select("lang", "sample_text")
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), samples, "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the documents whose label is missing or wrong, or that mix languages."""
    return _all(spark, sf_dir).where("is_case").select("doc_id", "seg_no", "lang")


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document, with its confidence."""
    return _all(spark, sf_dir).select("doc_id", "seg_no", "lang", "confidence", "n_sentences")


QUERIES = {"p9_found": p9_found, "p9_stretches": p9_stretches}
SQL: dict[str, str] = {}
