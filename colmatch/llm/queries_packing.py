"""Queries of problem 8: documents in containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.llm.bpe import encode
from colmatch.llm.packing import pack
from colmatch.plans.shared import materialize, table


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    sizes = materialize(docs.select(F.col("doc_id").alias("id"), F.size("ids").alias("size")), "sizes")
    budgets = table(spark, sf_dir, "context_budgets").where("tokenizer = 'byte_bpe_50k'")
    return pack(sizes, budgets)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each piece of one above the capacity."""
    p = _packed(spark, sf_dir)
    return p.select("budget_id", "container", F.col("id").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("start").alias("first_token"), F.col("size").alias("n_tokens"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers used, the least possible number, and the share of space used."""
    budgets = table(spark, sf_dir, "context_budgets").select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("long").alias("capacity"))
    per = _packed(spark, sf_dir).groupBy("budget_id").agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return per.join(F.broadcast(budgets), "budget_id").select("budget_id", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens",
                                                              F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
