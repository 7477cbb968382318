"""Value-overlap matcher: sets of distinct values, exact or fuzzy, Tversky-weighted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmatch.functions import expressions as X
from colmatch.functions.batches import partnered
from colmatch.functions.names import DISTANCES
from colmatch.functions.types import InvalidConfig, WorkLimits, check_work
from colmatch.plans.shared import materialize
from colmatch.sources.profile import Profile


def set_sizes(p: Profile) -> DataFrame:
    """col_id, n: distinct values of each column."""
    return p.counts.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))


def shared_values(p: Profile) -> DataFrame:
    """a, b, shared: values that two columns of different tables have in common, a's table first.

    One shuffle: the columns of each value (never more than there are columns) are
    gathered and paired where they are.
    """
    tables = F.broadcast(p.table().select("col_id", "table_no"))
    held = p.counts.join(tables, "col_id").groupBy("value").agg(F.collect_list(F.struct("table_no", "col_id")).alias("at")).where(F.size("at") > 1)
    met = F.flatten(F.transform("at", lambda x: F.transform(F.filter("at", lambda y: y["table_no"] > x["table_no"]), lambda y: F.struct(x["col_id"].alias("a"), y["col_id"].alias("b")))))
    return held.select(F.inline(met)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def work_counts(p: Profile) -> tuple[int, int]:
    """(column pairs, products of their distinct values), exactly."""
    r = (_sized_pairs(p).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("n_a").cast("decimal(38,0)") * F.col("n_b")).alias("work")).first())
    return int(r.cells), int(r.work or 0)


def _sized_pairs(p: Profile) -> DataFrame:
    n = set_sizes(p)
    pairs = p.pairs().select(F.col("col_id_a").alias("a"), F.col("col_id_b").alias("b"))
    x = F.broadcast(n.select(F.col("col_id").alias("a"), F.col("n").alias("n_a")))  # a row per column
    y = F.broadcast(n.select(F.col("col_id").alias("b"), F.col("n").alias("n_b")))
    return pairs.join(x, "a", "left").join(y, "b", "left").na.fill(0, ["n_a", "n_b"])


def exact_scores(p: Profile, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """a, b, score of column pairs with a common value."""
    n = set_sizes(p)
    x = F.broadcast(n.select(F.col("col_id").alias("a"), F.col("n").alias("n_a")))
    y = F.broadcast(n.select(F.col("col_id").alias("b"), F.col("n").alias("n_b")))
    s = F.col("shared")
    # the smaller set is the reference side, as its direction decides between the weights
    small = F.col("n_a") <= F.col("n_b")
    score = F.when(small, X.tversky(s, F.col("n_a"), s, F.col("n_b"), alpha, beta)).otherwise(X.tversky(s, F.col("n_b"), s, F.col("n_a"), alpha, beta))
    return shared_values(p).join(x, "a").join(y, "b").select("a", "b", score.alias("score"))


def _partners(distance: str, cutoff: float, more: set[int]):
    """Values of the left group with a partner among the right one's values of a column they ask for; without one too in the columns ``more``."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        xs, asked = left["value"].to_numpy(dtype=object), [np.asarray(ds, dtype=np.int64) for ds in left["ds"]]
        who, ds = np.repeat(np.arange(len(xs)), [len(d) for d in asked]), np.concatenate([np.empty(0, dtype=np.int64), *asked])
        ys = {d: y.to_numpy(dtype=object) for d, y in right.groupby("d")["y"]}
        out = [pd.DataFrame({"value": xs[:0], "d": ds[:0], "found": np.empty(0, dtype=bool)})]
        for d in np.unique(ds).tolist():
            asking = xs[who[ds == d]]
            found = partnered(distance, cutoff, asking, ys.get(d, xs[:0]))
            told = found | (d in more)
            out.append(pd.DataFrame({"value": asking[told], "d": d, "found": found[told]}))
        return pd.concat(out, ignore_index=True)

    return run


def _met(left: DataFrame, right: DataFrame, keys: list[str], groups: int, run) -> DataFrame:
    """The groups of both sides brought together, a task for each as far as there are not too many.

    Neither side is ever broadcast: their size is not that of the files they come from.
    """
    n = max(1, min(groups, 4_000))
    return (left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))
                .applyInPandas(run, "value string, d int, found boolean"))


def matched_values(p: Profile, distance: str, threshold: float, block: int = 4096) -> DataFrame:
    """value, d: values of any column with a partner in column ``d`` of another table, at least as similar as the threshold.

    One partner is enough, so nothing of the size of all pairs is written: equal values
    need no comparison (columns of the same values are done at once). The rest meets one
    block of about ``block`` values of each column, and what has no partner there all
    other blocks of the column.
    """
    cutoff = X.float_cutoff(threshold)
    info = {c.col_id: c.table_no for c in p.columns}
    held = p.counts.select("col_id", "value")
    sizes = {r.col_id: r.n for r in held.groupBy("col_id").agg(F.count(F.lit(1)).alias("n")).orderBy("col_id").collect()}  # a row per column
    same = held.select("value", F.col("col_id").alias("d"))
    if not sizes:
        return same
    blocks, bundle, room = {c: -(-n // block) for c, n in sizes.items()}, {}, 0
    for c, n in sizes.items():  # columns that are met at once: up to 16 blocks
        room += min(n, block)
        bundle[c] = room // (16 * block)
    bundles = max(bundle.values()) + 1
    targets = F.array(*(F.struct(F.lit(c).alias("d"), F.lit(info[c]).alias("t"), F.lit(bundle[c]).alias("g")) for c in sizes))
    numbers = _literal_map({c: info[c] for c in sizes})
    owners = held.groupBy("value").agg(F.collect_list("col_id").alias("cols"))
    owned = materialize(owners.withColumn("tabs", F.transform("cols", lambda c: numbers[c])), "values")
    asked = owned.select("value", F.filter(targets, lambda x: ~F.array_contains("cols", x["d"]) & F.exists("tabs", lambda t: t != x["t"])).alias("x"))
    if cutoff <= 0:
        return same.unionByName(asked.select("value", F.explode("x.d").alias("d")))
    cores, values = held.sparkSession.sparkContext.defaultParallelism, owned.count()
    lefts = _chunks(values, block, cores)
    left = (asked.select("value", "x", F.pmod(F.xxhash64("value"), F.lit(lefts)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("g"))
                 .select("value", "i", "g", F.transform(F.filter("x", lambda x: x["g"] == F.col("g")), lambda x: x["d"]).alias("ds")).where(F.size("ds") > 0))
    dealt = held.select(F.col("col_id").alias("d"), F.col("value").alias("y"), F.pmod(F.xxhash64("value"), _literal_map(blocks)[F.col("col_id")]).cast("int").alias("b"))
    right = dealt.where("b = 0").select("d", "y", _literal_map(bundle)[F.col("d")].alias("g"), F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("i"))
    met = materialize(_met(left, right, ["i", "g"], lefts * bundles, _partners(distance, cutoff, {c for c, n in blocks.items() if n > 1})), "met")
    same = same.unionByName(met.where("found").select("value", "d"))
    without = met.where("NOT found")
    rest = {r.d: r.n for r in without.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per column
    if not rest:
        return same
    chunks = {d: _chunks(n, block, cores) for d, n in rest.items()}
    spans = {d: -(-(blocks[d] - 1) // 16) for d in rest}
    left = without.select("value", "d", F.array("d").alias("ds"), F.pmod(F.xxhash64("value", F.lit(1)), _literal_map(chunks)[F.col("d")]).cast("int").alias("i"),
                          F.explode(F.sequence(F.lit(0), _literal_map(spans)[F.col("d")] - 1)).alias("j"))
    right = (dealt.where((F.col("b") > 0) & F.col("d").isin(list(rest)))
                  .select("d", "y", F.floor((F.col("b") - 1) / 16).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), _literal_map(chunks)[F.col("d")] - 1)).alias("i")))
    more = _met(left, right, ["d", "i", "j"], sum(chunks[d] * spans[d] for d in rest), _partners(distance, cutoff, set()))
    return same.unionByName(more.select("value", "d").distinct())


def _chunks(n: int, block: int, cores: int) -> int:
    """Into how many parts n values are dealt: enough for all cores, none above a block."""
    return max(1, -(-n // min(block, max(256, n // (4 * cores)))))


def _literal_map(of: dict):
    return F.create_map(*(F.lit(x) for pair in of.items() for x in pair))


def fuzzy_scores(p: Profile, distance: str = "levenshtein", threshold: float = 0.8, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """a, b, score: a value counts as matched if any partner is similar enough, in both directions.

    Distinct values are compared once, whatever number of columns holds them.
    """
    p = Profile(p.columns, materialize(p.counts, "counts"))  # read several times
    return _semi_scores(p, matched_values(p, distance, threshold), alpha, beta)


def _semi_scores(p: Profile, matched: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``matched``: value, d. A row per value and column meets the columns that hold the value."""
    tables = F.broadcast(p.table().select("col_id", "table_no"))
    held = p.counts.select("col_id", "value").join(tables, "col_id").select(F.col("col_id").alias("c"), F.col("table_no").alias("t_c"), "value")
    to = matched.join(tables.select(F.col("col_id").alias("d"), F.col("table_no").alias("t_d")), "d")
    met = held.join(to, "value").where(F.col("t_c") != F.col("t_d"))
    # of c's values with a partner in d; a row per column pair, read in both directions
    hits = materialize(met.groupBy("c", "d", "t_c", "t_d").agg(F.count(F.lit(1)).alias("m")), "hits")
    fwd = hits.where("t_c < t_d").select(F.col("c").alias("a"), F.col("d").alias("b"), F.col("m").alias("m_a"))
    back = hits.where("t_c > t_d").select(F.col("d").alias("a"), F.col("c").alias("b"), F.col("m").alias("m_b"))
    n = set_sizes(p)
    i = F.broadcast(n.select(F.col("col_id").alias("a"), F.col("n").alias("n_a")))
    j = F.broadcast(n.select(F.col("col_id").alias("b"), F.col("n").alias("n_b")))
    small = F.col("n_a") <= F.col("n_b")
    score = (F.when(small, X.tversky(F.col("m_a"), F.col("n_a"), F.col("m_b"), F.col("n_b"), alpha, beta))
              .otherwise(X.tversky(F.col("m_b"), F.col("n_b"), F.col("m_a"), F.col("n_a"), alpha, beta)))
    return fwd.join(back, ["a", "b"]).join(i, "a").join(j, "b").select("a", "b", score.alias("score"))


def vector_scores(p: Profile, embeddings: DataFrame, threshold: float = 0.8, alpha: float = 1.0, beta: float = 1.0, block: int = 1024) -> DataFrame:
    """a, b, score with the cosine of precomputed vectors (value, vector) in place of a distance.

    Every value of the profile must have a vector. Vectors are compared in blocks, a
    matrix product per block pair; the cutoff is not rounded.
    """
    vocab = p.counts.select("value").distinct()
    known = vocab.join(embeddings.select("value", X.unit_vector(F.col("vector")).alias("v")), "value", "left")
    if not known.where(F.col("v").isNull()).isEmpty():
        raise InvalidConfig("a value has no usable vector")
    holders = p.counts.select(F.col("value").alias("y"), F.col("col_id").alias("d"))
    return _semi_scores(p, near_vectors(known, threshold, block).join(holders, "y").select(F.col("x").alias("value"), "d").distinct(), alpha, beta)


def near_vectors(known: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """x, y: values whose unit vectors (value, v) have a cosine of at least the threshold."""
    blocks = max(1, -(-known.count() // block))
    b = known.withColumn("blk", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int"))
    left = b.select("value", "v", "blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    right = b.select(F.col("value").alias("value_y"), F.col("v").alias("v_y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk_y"), F.col("blk").alias("other_y"))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"x": [], "y": []})
        sim = np.clip(np.stack(left["v"]) @ np.stack(right["v_y"]).T, -1, 1)
        i, j = np.nonzero(sim >= threshold)
        return pd.DataFrame({"x": left["value"].to_numpy()[i], "y": right["value_y"].to_numpy()[j]})

    return left.groupBy("blk", "other").cogroup(right.groupBy("blk_y", "other_y")).applyInPandas(product, "x string, y string")


def jaccard(p: Profile, distance: str = "levenshtein", threshold: float = 0.8, alpha: float = 1.0, beta: float = 1.0,
            embeddings: DataFrame | None = None, limits: WorkLimits | None = None) -> DataFrame:
    """The matcher: named pairs with a score above 0.

    Empty columns match nothing. Exact mode ignores the threshold. ``limits`` are
    checked on two counts before values meet.
    """
    if not 0.0 <= threshold <= 1.0 or alpha < 0 or beta < 0:
        raise InvalidConfig("threshold must be between 0 and 1, weights not negative")
    if embeddings is None and distance not in DISTANCES:
        raise InvalidConfig(f"distance {distance}")
    if limits is not None:
        cells, work = work_counts(p)
        check_work("column pairs", cells, limits.max_matrix_cells)
        check_work("value comparisons", work, limits.max_jaccard_comparisons)
    if embeddings is not None:
        scored = vector_scores(p, embeddings, threshold, alpha, beta)
    elif distance == "exact":
        scored = exact_scores(p, alpha, beta)
    else:
        scored = fuzzy_scores(p, distance, threshold, alpha, beta)
    return p.named(scored.where("score > 0"))
