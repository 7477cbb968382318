"""Name and instance matcher: trigrams and tokens of names, TF-IDF of values, two-sided selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions import expressions as X
from colmatch.functions.names import tokens_similarity
from colmatch.functions.types import InvalidConfig
from colmatch.plans.shared import materialize
from colmatch.sources.profile import Profile


@F.pandas_udf(T.DoubleType())
def _tokens_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([tokens_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def name_scores(p: Profile) -> DataFrame:
    """a, b, name_score of all column pairs of different tables."""
    pairs = p.pairs()
    return pairs.select(F.col("col_id_a").alias("a"), F.col("col_id_b").alias("b"), "table_no_a", "table_no_b", F.greatest(X.trigram_similarity(F.col("column_a"), F.col("column_b")), _tokens_similarity("column_a", "column_b")).alias("name_score"))


def documents(p: Profile) -> DataFrame:
    """value, tokens of every distinct value that has a token."""
    return p.counts.select("value").distinct().select("value", X.document_tokens(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)


def idf(p: Profile) -> DataFrame:
    """token, df, idf: a value counts as often as it stands in any column of the batch."""
    times = p.counts.groupBy("value").agg(F.sum("n").alias("n"))
    docs = times.select("n", X.document_tokens(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)
    total = docs.agg(F.sum("n").alias("total"))
    per = docs.select("n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.sum("n").alias("df"))
    return per.join(F.broadcast(total)).select("token", "df", F.log(F.col("total") / F.col("df")).alias("idf"))


def vectors(p: Profile) -> DataFrame:
    """value, token, weight: unit vectors of sqrt(tf) * idf, weights above 0 only."""
    tf = documents(p).select("value", F.explode("tokens").alias("token")).groupBy("value", "token").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf(p).select("token", "idf"), "token").select("value", "token", (F.sqrt(F.col("tf").cast("double")) * F.col("idf")).alias("w")).where("w > 0")
    norm = w.groupBy("value").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "value").select("value", "token", (F.col("w") / F.col("norm")).alias("weight"))


def instance_scores(p: Profile) -> DataFrame:
    """a, b, instance_score of column pairs whose values share a weighted token.

    The cosine of two values is computed once, whatever number of columns holds them,
    and only for values that different tables hold; a token of one table meets nobody.
    """
    tables = F.broadcast(p.table().select("col_id", "table_no"))
    # the only table that holds a value, -1 if there are several: values of one table alone never meet
    owner = (p.counts.join(tables, "col_id").groupBy("value").agg(F.min("table_no").alias("lo"), F.max("table_no").alias("hi"))
              .select("value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("tab")))
    vec = materialize(vectors(p).join(owner, "value"), "vectors")
    across = vec.groupBy("token").agg(F.min("tab").alias("lo"), F.max("tab").alias("hi")).where("lo <> hi or lo = -1").select("token")
    met = vec.join(across, "token", "left_semi")
    x = met.select(F.col("value").alias("x"), "token", F.col("weight").alias("wx"), F.col("tab").alias("tx"))
    y = met.select(F.col("value").alias("y"), "token", F.col("weight").alias("wy"), F.col("tab").alias("ty"))
    apart = (F.col("tx") != F.col("ty")) | (F.col("tx") == -1)
    cos = x.join(y, "token").where(apart).groupBy("x", "y").agg(F.least(F.sum(F.col("wx") * F.col("wy")), F.lit(1.0)).alias("c"))
    has = documents(p).select("value")
    held = materialize(p.counts.join(has, "value").join(tables, "col_id"), "held")
    left = held.select(F.col("value").alias("x"), F.col("col_id").alias("c1"), F.col("table_no").alias("t1"), F.col("n").alias("n1"))
    right = held.select(F.col("value").alias("y"), F.col("col_id").alias("c2"), F.col("table_no").alias("t2"))
    best = materialize(left.join(cos, "x").join(right, "y").where(F.col("t1") != F.col("t2"))
                .groupBy("c1", "c2", "t1", "t2", "x").agg(F.max("c").alias("c"), F.first("n1").alias("n1"))
                .groupBy("c1", "c2", "t1", "t2").agg(F.sum(F.col("c") * F.col("n1")).alias("s")), "best")
    fwd = best.where("t1 < t2").select(F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("s").alias("s_a"))
    back = best.where("t1 > t2").select(F.col("c2").alias("a"), F.col("c1").alias("b"), F.col("s").alias("s_b"))
    occ = held.groupBy("col_id").agg(F.sum("n").alias("occ"))
    i = F.broadcast(occ.select(F.col("col_id").alias("a"), F.col("occ").alias("occ_a")))
    j = F.broadcast(occ.select(F.col("col_id").alias("b"), F.col("occ").alias("occ_b")))
    return (fwd.join(back, ["a", "b"]).join(i, "a").join(j, "b")
               .select("a", "b", ((F.col("s_a") + F.col("s_b")) / (F.col("occ_a") + F.col("occ_b"))).alias("instance_score")))


def select_both(scored: DataFrame, max_n: int = 0, delta: float = 0.15, threshold: float = 0.0) -> DataFrame:
    """Pairs above 0 that reach the cutoff of both their source and their target.

    ``scored``: a, b, table_no_a, table_no_b, score with all pairs of a table pair. A
    cutoff is the largest of the threshold, the n-th best score (ties stay) and the
    best score less the share ``delta``.
    """
    def cut(side: str):
        w = Window.partitionBy("table_no_a", "table_no_b", side)
        parts = [F.lit(float(threshold))]
        if max_n > 0:
            ordered = F.sort_array(F.collect_list("score").over(w), asc=False)
            parts.append(F.get(ordered, F.least(F.lit(max_n), F.size(ordered)) - 1))
        if delta > 0:
            parts.append(F.max("score").over(w) * (1 - delta))
        return F.greatest(*parts) if len(parts) > 1 else parts[0]

    cuts = scored.withColumn("cut_a", cut("a")).withColumn("cut_b", cut("b"))
    return cuts.where((F.col("score") > 0) & (F.col("score") >= F.col("cut_a")) & (F.col("score") >= F.col("cut_b"))).drop("cut_a", "cut_b")


def combined(p: Profile, use_schema: bool = True, use_instances: bool = False, instance_weight: float = 1.0) -> DataFrame:
    """a, b, tables, score and its parts name_score and instance_score for all column pairs."""
    scored = name_scores(p)
    if use_instances:
        scored = scored.join(instance_scores(p), ["a", "b"], "left").na.fill(0.0, ["instance_score"])
    total = (1.0 if use_schema else 0.0) + (instance_weight if use_instances else 0.0)
    up = (F.col("name_score") if use_schema else F.lit(0.0)) + (F.lit(instance_weight) * F.col("instance_score") if use_instances else F.lit(0.0))
    return scored.withColumn("score", up / total if total else F.lit(0.0))


def coma(p: Profile, max_n: int = 0, use_instances: bool = False, use_schema: bool = True, delta: float = 0.15, threshold: float = 0.0, instance_weight: float = 1.0) -> DataFrame:
    """The matcher: named pairs with score and details NameCM and InstancesCM."""
    if max_n < 0 or not 0 <= delta <= 1 or not 0 <= threshold <= 1 or instance_weight < 0:
        raise InvalidConfig("max_n and instance_weight must not be negative; delta and threshold are between 0 and 1")
    chosen = select_both(combined(p, use_schema, use_instances, instance_weight), max_n, delta, threshold)
    parts = [x for use, kv in ((use_schema, ("NameCM", "name_score")), (use_instances, ("InstancesCM", "instance_score"))) if use for x in (F.lit(kv[0]), F.col(kv[1]))]
    details = F.create_map(*parts) if parts else F.create_map().cast("map<string,double>")
    return p.named(chosen.select("a", "b", "score", details.alias("details")))
