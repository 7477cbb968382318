"""Suggestions: a match, an ambiguity or no match for every source field.

Names are scored once per distinct pair of names in Arrow batches, values in common
are counted by a join on the value; everything else is column arithmetic and windows
over source fields.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmatch.functions import expressions as X
from colmatch.functions.names import abbreviation_score, name_score, normalize_name
from colmatch.functions.types import Config
from colmatch.plans.shared import materialize


@F.pandas_udf(T.DoubleType())
def _name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_score(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _abbreviation(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([abbreviation_score(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def _bare_name(a: pd.Series) -> pd.Series:
    return a.map(normalize_name)


def _listed(fields: DataFrame) -> DataFrame:
    return fields.select("pos", F.explode("samples").alias("value"))


def overlaps(source: DataFrame, target: DataFrame) -> DataFrame:
    """s_pos, t_pos, sample_score of fields that both have values (pos, value), however many.

    Values count without case and blanks at the ends. One shuffle of the values: the
    fields of each value (never more than there are fields) are gathered and paired.
    """
    of = lambda df, target: df.select(F.lit(target).alias("target"), "pos", F.lower(F.trim("value")).alias("value")).where(F.col("value") != "")
    values = of(source, False).unionByName(of(target, True))
    held = materialize(values.groupBy("value").agg(F.collect_set(F.struct("target", "pos")).alias("at")), "held")
    sizes = held.select(F.inline("at")).groupBy("target", "pos").agg(F.count(F.lit(1)).alias("n"))
    met = F.flatten(F.transform(F.filter("at", lambda x: ~x["target"]), lambda x: F.transform(
        F.filter("at", lambda y: y["target"]), lambda y: F.struct(x["pos"].alias("s_pos"), y["pos"].alias("t_pos")))))
    shared = held.select(F.inline(met)).groupBy("s_pos", "t_pos").agg(F.count(F.lit(1)).alias("shared"))
    # a row per field or pair of fields
    both = (sizes.where("not target").select(F.col("pos").alias("s_pos"), F.col("n").alias("n"))
            .join(F.broadcast(sizes.where("target").select(F.col("pos").alias("t_pos"), F.col("n").alias("m")))))
    score = F.when((F.col("n") < 2) | (F.col("m") < 2), 0.0).otherwise(F.coalesce("shared", F.lit(0)) / F.greatest("n", "m"))
    return both.join(F.broadcast(shared), ["s_pos", "t_pos"], "left").select("s_pos", "t_pos", score.alias("sample_score"))


def candidates(source: DataFrame, target: DataFrame, source_values: DataFrame | None = None, target_values: DataFrame | None = None) -> DataFrame:
    """All pairs of fields with their component scores.

    Inputs: pos, name, data_type and samples (array), or values (pos, value) in place
    of samples. Output: s_pos, source, t_pos, target, name_score, abbr_score,
    type_score, sample_score (null without samples on either side; a best score that
    several targets share counts half), exact.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("pos").alias(f"{p}_pos"), F.col("name").alias(p), F.col("data_type").alias(f"{p}_type"), _bare_name(F.coalesce("name", F.lit(""))).alias(f"{p}_bare"))

    met = materialize(overlaps(_listed(source) if source_values is None else source_values, _listed(target) if target_values is None else target_values), "overlaps")
    # fields are metadata: a schema, not a table of values, is sent to the other side
    pairs = side(source, "s").join(F.broadcast(side(target, "t"))).join(F.broadcast(met), ["s_pos", "t_pos"], "left")
    scored = pairs.select("s_pos", F.col("s").alias("source"), "t_pos", F.col("t").alias("target"), _name_score("s", "t").alias("name_score"), _abbreviation("s", "t").alias("abbr_score"),
                          X.suggestion_type_score(F.col("s_type"), F.col("t_type")).alias("type_score"), "sample_score", (F.col("s_bare") == F.col("t_bare")).alias("exact"))
    top = F.max("sample_score").over(Window.partitionBy("s_pos"))
    tied = F.abs(F.col("sample_score") - F.col("top")) <= 1e-12
    many = F.sum(F.when(tied, 1).otherwise(0)).over(Window.partitionBy("s_pos"))
    return (scored.withColumn("top", top).withColumn("many", many)
                  .withColumn("sample_score", F.when((F.col("top") > 0) & (F.col("many") > 1) & tied, F.col("sample_score") / 2).otherwise(F.col("sample_score")))
                  .drop("top", "many"))


def _combined(scored: DataFrame, name: Column) -> DataFrame:
    base = 0.60 * name + 0.25 * F.col("type_score")
    full = F.when(F.col("sample_score").isNull(), base / 0.85).otherwise(base + 0.15 * F.col("sample_score"))
    floor = F.when(F.col("exact") & (F.col("type_score") >= 0.75), F.greatest(full, F.lit(0.98))).otherwise(full)
    return scored.withColumn("used_name", name).withColumn("evidence", base).withColumn("score", floor)


def _decided(scored: DataFrame, c: Config) -> DataFrame:
    w = Window.partitionBy("s_pos").orderBy(F.col("score").desc(), "target", "t_pos")
    placed = scored.withColumn("place", F.row_number().over(w))
    entry = F.struct("place", "target", "t_pos", "score", F.col("used_name").alias("name_score"), "type_score", "sample_score", "evidence")
    per = placed.groupBy("s_pos", "source").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    best = F.get("all", F.lit(0))
    weak = best["sample_score"].isNull() & (best["evidence"] < c.min_score)
    none = (best["score"] < c.min_score) | weak
    near = F.filter("all", lambda x: (x["score"] >= c.min_score) & (best["score"] - x["score"] <= c.ambiguity_margin))
    names = F.transform(near, lambda x: x["target"])
    kind = F.when(none, "no_match").when(F.size(near) > 1, "ambiguous").otherwise("match")
    return per.select("s_pos", "source", kind.alias("decision"), best["score"].alias("best_score"),
                      F.when(kind == "match", best["target"]).alias("target"), F.when(kind == "ambiguous", names).otherwise(F.array().cast("array<string>")).alias("targets"),
                      F.slice("all", 1, max(c.max_candidates, 0)).alias("candidates") if c.max_candidates else F.slice("all", 1, 0).alias("candidates"))


def suggest(source: DataFrame, target: DataFrame, config: Config | None = None, source_values: DataFrame | None = None, target_values: DataFrame | None = None) -> DataFrame:
    """s_pos, source, decision (match, ambiguous, no_match), best_score, target, targets, candidates.

    Fields without a match are tried again with abbreviations as evidence on names,
    and then both decision and candidates come from the second pass. A field without
    any target has no_match and a null score. Duplicate and empty names are kept apart by pos.
    """
    c = config or Config()
    scored = candidates(source, target, source_values, target_values)
    first = _decided(_combined(scored, F.col("name_score")), c)
    again = _decided(_combined(scored, F.greatest("name_score", "abbr_score")), c)
    settled = first.where("decision <> 'no_match'")
    rest = again.join(settled.select("s_pos"), "s_pos", "left_anti")
    found = settled.unionByName(rest)
    return (source.select(F.col("pos").alias("s_pos"), F.col("name").alias("source")).join(found.drop("source"), "s_pos", "left")
                  .withColumn("decision", F.coalesce("decision", F.lit("no_match"))))
