"""Ranked matches: order, cutoffs, top-k and selectors.

A result is a DataFrame with source_table, source_column, target_table,
target_column, score and, where a matcher tells more, details (map). All
operators hold over the whole collection, not per table pair.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colmatch.functions.types import InvalidConfig, InvalidInput, WorkLimits, check_work
from colmatch.operators import assign
from colmatch.plans.shared import materialize

KEYS = ["source_table", "source_column", "target_table", "target_column"]
SOURCE, TARGET = KEYS[:2], KEYS[2:]


def _order():
    return [F.col("score").desc(), *map(F.col, KEYS)]


def ranked(matches: DataFrame) -> DataFrame:
    """Score descending, then names ascending by bytes."""
    return matches.orderBy(*_order())


def checked(matches: DataFrame) -> DataFrame:
    """``matches``, if every pair is there once and every score is between 0 and 1."""
    bad = matches.where(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0.0, 1.0))
    if not bad.isEmpty():
        raise InvalidInput("a score is not between 0 and 1")
    if not matches.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise InvalidInput("a pair is there twice")
    return matches


def filter_score(matches: DataFrame, least: float) -> DataFrame:
    if not math.isfinite(least):
        raise InvalidConfig("a score filter must be finite")
    return matches.where(F.col("score") >= least)


def take_top_n(matches: DataFrame, n: int) -> DataFrame:
    return ranked(matches).limit(n)


def take_top_percent(matches: DataFrame, percent: float) -> DataFrame:
    """The best ceil(percent * count / 100) pairs."""
    if not 0 <= percent <= 100:
        raise InvalidConfig("percent must be between 0 and 100")
    return take_top_n(matches, math.ceil(percent * matches.count() / 100))


def _best(matches: DataFrame, side: list[str], name: str) -> DataFrame:
    return matches.withColumn(name, F.row_number().over(Window.partitionBy(*side).orderBy(*_order())))


def take_top_n_per_source(matches: DataFrame, n: int) -> DataFrame:
    return _best(matches, SOURCE, "__r").where(F.col("__r") <= n).drop("__r")


def one_to_one_mutual_top(matches: DataFrame, n: int = 1) -> DataFrame:
    """Among the ``n`` best of both its source and its target."""
    if n < 1:
        raise InvalidConfig("n must be at least 1")
    return _best(_best(matches, SOURCE, "__s"), TARGET, "__t").where((F.col("__s") <= n) & (F.col("__t") <= n)).drop("__s", "__t")


def default_cutoff(matches: DataFrame) -> float:
    """Of the c distinct scores in descending order that at place min(ceil(c / 2), c - 1); 0 if there is none."""
    scores = matches.select("score").distinct()
    c = scores.count()
    if not c:
        return 0.0
    at = min(math.ceil(c / 2), c - 1)
    return scores.orderBy(F.desc("score")).limit(at + 1).agg(F.min("score")).first()[0]


def one_to_one_greedy(matches: DataFrame, threshold: float | None = None) -> DataFrame:
    """Going down the ranking, pairs whose both ends are still free.

    Each round takes the pairs that lead both their source and their target and
    drops all that share an end with them; the result equals the sequential scan.
    """
    cut = default_cutoff(matches) if threshold is None else threshold
    left = materialize(filter_score(matches, cut), "greedy")
    taken = None
    while not left.isEmpty():
        lead = materialize(one_to_one_mutual_top(left, 1), "lead")
        taken = lead if taken is None else taken.unionByName(lead)
        left = materialize(left.join(lead.select(*SOURCE), SOURCE, "left_anti").join(lead.select(*TARGET), TARGET, "left_anti").select(*matches.columns), "greedy")
    return matches.limit(0) if taken is None else taken


def one_to_one(matches: DataFrame, method: str = "hungarian", threshold: float | None = None, limits: WorkLimits | None = None) -> DataFrame:
    """An optimal one-to-one selection over the whole collection.

    hungarian: most total score on a square matrix, then pairs from the threshold
    up; hungarian_aware: most pairs from the threshold up, then most score;
    rectangular and rectangular_aware: the same without padding. The cells are
    solved exactly in one group, as the objective is over all of them; ``limits`` are
    checked on counts before anything is gathered. Distinct columns bound the matrix.
    """
    if method not in ("hungarian", "hungarian_aware", "rectangular", "rectangular_aware"):
        raise InvalidConfig(f"method {method}")
    cut = default_cutoff(matches) if threshold is None else threshold
    if limits is not None:
        rows, cols = matches.select(*SOURCE).distinct().count(), matches.select(*TARGET).distinct().count()
        check_work("assignment dimension", max(rows, cols), limits.max_assignment_dimension)
        check_work("assignment cells", rows * cols, limits.max_matrix_cells)
    solve = assign.grouped(method, cut)
    schema = matches.select(*KEYS, "score").schema
    picked = matches.select(*KEYS, "score", F.lit(0).alias("__all")).groupBy("__all").applyInPandas(solve, schema)
    return matches.join(picked.select(*KEYS), KEYS, "left_semi")
