"""Queries of problem 7: token ids of every document, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.llm.bpe import decode, encode
from colmatch.plans.shared import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids under byte_bpe_50k; the empty list for empty and null texts."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document comes back from its ids, and its number of tokens above 0."""
    d = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    same = decode(d, "ids").select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"), (F.size("ids") > 0).alias("has_tokens"))
    return same


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}

SQL = {"p7_roundtrip": "SELECT doc_id, true AS same, coalesce(length(text), 0) > 0 AS has_tokens FROM documents"}
