"""How distinctive each term of a record is against all records.

Counts are plain DataFrame arithmetic: tf per (record, term), df and total per
term, margins of rows and columns. ``residual`` weighs by adjusted residuals of
the record x term table (observed minus expected over the root of expected,
divided by the root of what the margins leave free); ``tfidf`` weighs
sqrt(tf) * ln(N / df). Both use the same counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmatch.plans.shared import materialize, spread
from colmatch.plans.skew import join_counted


def terms_of(samples: Column) -> Column:
    """The longest runs of a-z and 0-9 in the lower-cased samples, repeats included."""
    there = F.filter(samples, lambda s: s.isNotNull())
    return F.flatten(F.transform(there, lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))))


def term_weights(df: DataFrame, id_col: str, samples: str, method: str = "residual", digits: int = 9) -> DataFrame:
    """``id_col``, term, tf, weight for every term of every row.

    A null or empty list, null samples and samples without a term give no rows; a
    row that is delivered again under another id counts for itself. Other columns
    are ignored, whatever their names.
    """
    if method not in ("residual", "tfidf"):
        raise ValueError(f"method: {method}")
    slim = spread(df.select(F.col(id_col).alias("__id"), F.col(samples).alias("__samples")))
    tf = (slim.select("__id", F.explode(terms_of(F.col("__samples"))).alias("term"))
            .groupBy("__id", "term").agg(F.count(F.lit(1)).alias("tf")))
    tf = materialize(tf, "tf")
    totals = tf.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
    per_term = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("term_total"))
    joined = join_counted(tf, per_term, "term", "df", totals.cells)
    if method == "tfidf":
        rows = tf.select("__id").distinct().count()
        weight = F.sqrt(F.col("tf").cast("double")) * F.log(F.lit(float(rows)) / F.col("df"))
    else:
        row_total = tf.groupBy("__id").agg(F.sum("tf").alias("row_total"))
        joined = joined.join(row_total, "__id")
        n = float(totals.tokens)
        r, c = F.col("row_total") / F.lit(n or 1.0), F.col("term_total") / F.lit(n or 1.0)
        expected = r * c * n
        free = (1 - r) * (1 - c)
        weight = F.when(free > 0, (F.col("tf") - expected) / F.sqrt(expected) / F.sqrt(free)).otherwise(F.lit(0.0))
    return joined.select(F.col("__id").alias(id_col), "term", "tf", F.round(weight, digits).alias("weight"))


def heaviest_terms(weights: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """The ``n`` heaviest terms of weight above 0 of each row; ties to the smaller term by bytes."""
    w = Window.partitionBy(id_col).orderBy(F.col("weight").desc(), "term")
    return weights.where("weight > 0").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
