"""Evaluation of matches against a ground truth.

The truth has four key columns, or two (source_column, target_column) where tables
don't matter. Every measure is a few aggregates; the driver gets counts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colmatch.functions.types import InvalidConfig
from colmatch.operators import results
from colmatch.operators.results import KEYS
from colmatch.plans.ranking import global_rank


def truth_keys(truth: DataFrame) -> list[str]:
    return KEYS if set(KEYS) <= set(truth.columns) else ["source_column", "target_column"]


def select_one_to_one(matches: DataFrame, how: str = "hungarian", threshold: float | None = None) -> DataFrame:
    if how == "greedy":
        return results.one_to_one_greedy(matches, threshold)
    if how == "mutual_top":
        return results.one_to_one_mutual_top(matches, 1)
    return results.one_to_one(matches, how, threshold)


def counts(matches: DataFrame, truth: DataFrame) -> tuple[int, int, int]:
    """(hits, false hits, missed) of distinct keys."""
    on = truth_keys(truth)
    found = matches.select(*on).distinct().withColumn("f", F.lit(1))
    gold = truth.select(*on).distinct().withColumn("g", F.lit(1))
    r = found.join(gold, on, "full_outer").agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("f").isNull())).first()
    return r[0], r[1], r[2]


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def precision(matches: DataFrame, truth: DataFrame) -> float:
    hit, false, _ = counts(matches, truth)
    return _ratio(hit, hit + false)


def recall(matches: DataFrame, truth: DataFrame) -> float:
    hit, _, missed = counts(matches, truth)
    return _ratio(hit, hit + missed)


def f1(matches: DataFrame, truth: DataFrame) -> float:
    hit, false, missed = counts(matches, truth)
    return _ratio(2 * hit, 2 * hit + false + missed)


def precision_top_n_percent(matches: DataFrame, truth: DataFrame, percent: float) -> float:
    return precision(results.take_top_percent(matches, percent), truth)


def recall_at_size_of_truth(matches: DataFrame, truth: DataFrame) -> float:
    """Recall of as many best candidates as the truth has pairs."""
    return recall(results.take_top_n(matches, truth.select(*truth_keys(truth)).distinct().count()), truth)


def mean_reciprocal_rank(matches: DataFrame, truth: DataFrame) -> float:
    """Over the truth's sources: 1 / place of the first right target among the source's candidates."""
    on = truth_keys(truth)
    side = on[: len(on) // 2]
    ranks = matches.withColumn("r", F.row_number().over(Window.partitionBy(*side).orderBy(F.col("score").desc(), *map(F.col, KEYS))))
    gold = truth.select(*on).distinct()
    first = ranks.join(gold, on, "left_semi").groupBy(*side).agg((1.0 / F.min("r")).alias("rr"))
    sources = gold.select(*side).distinct()
    return sources.join(first, side, "left").agg(F.coalesce(F.avg(F.coalesce("rr", F.lit(0.0))), F.lit(0.0))).first()[0]


def precision_curve(selection: DataFrame, truth: DataFrame) -> DataFrame:
    """percent (10 to 100), precision of the best part of one selection."""
    on = truth_keys(truth)
    total = selection.count()
    placed = global_rank(selection, results._order(), "r").join(
        truth.select(*on).distinct().withColumn("g", F.lit(1)), on, "left")
    steps = placed.select("r", "g", F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))).alias("percent"))
    return (steps.where(F.col("r") <= F.ceil(F.col("percent") * F.lit(total) / 100)).groupBy("percent")
                 .agg((F.count("g") / F.count(F.lit(1))).alias("precision")))


Metric = Callable[[DataFrame, DataFrame], float]

# Named sets; those that ask for a selection get the one-to-one part of the matches.
PRECISION_RECALL: dict[str, Metric] = {"Precision": precision, "Recall": recall}
ON_SELECTION: dict[str, Metric] = {**PRECISION_RECALL, "F1Score": f1, **{f"PrecisionTop{n}Percent": (lambda m, t, n=n: precision_top_n_percent(m, t, n)) for n in range(10, 101, 10)}}
ON_ALL: dict[str, Metric] = {"RecallAtSizeofGroundTruth": recall_at_size_of_truth, "MeanReciprocalRank": mean_reciprocal_rank}

CORE: list[str] = ["Precision", "Recall", "F1Score", "PrecisionTop10Percent", *ON_ALL]
INCREASING_N: list[str] = [f"PrecisionTop{n}Percent" for n in range(10, 101, 10)]


def get_metrics(matches: DataFrame, truth: DataFrame, names: list[str] | None = None, how: str = "hungarian", extra: dict[str, Metric] | None = None) -> dict[str, float]:
    """Measures by name; the selection is made once for all that need it. A name twice is an error."""
    clash = set(extra or {}) & {*ON_SELECTION, *ON_ALL}
    if clash:
        raise InvalidConfig(f"metric {sorted(clash)[0]} is there twice")
    wanted = names or [*PRECISION_RECALL, "F1Score", *(f"PrecisionTop{n}Percent" for n in (10, 30, 50, 70, 90)), *ON_ALL, *(extra or {})]
    unknown = [n for n in wanted if n not in ON_SELECTION and n not in ON_ALL and n not in (extra or {})]
    if unknown:
        raise InvalidConfig(f"metric {unknown[0]}")
    chosen = select_one_to_one(matches, how).persist() if any(n in ON_SELECTION for n in wanted) else None
    out = {}
    for n in wanted:
        out[n] = ON_SELECTION[n](chosen, truth) if n in ON_SELECTION else (ON_ALL.get(n) or extra[n])(matches, truth)
        if not math.isfinite(out[n]):
            raise InvalidConfig(f"metric {n} isn't finite")
    if chosen is not None:
        chosen.unpersist()
    return out
