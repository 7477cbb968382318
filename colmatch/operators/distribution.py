"""Distribution matcher: quantile histograms over global value ranks, two phases of clustering.

Values stay distributed: global ranks come from a range-partitioned sort, quantile
boundaries from running counts, and the distances of all column pairs from one pass
that counts each column's values between all boundaries. A column's counts are one
row; its distances to all others are computed where it lies. The driver holds the
boundaries and a number per column pair, never values or counts of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmatch.functions.types import InvalidConfig, WorkLimits, check_work
from colmatch.operators.cluster import components, correlation_clusters
from colmatch.plans.ranking import global_rank
from colmatch.plans.shared import materialize
from colmatch.sources.profile import Profile


def parsed_number(value: Column) -> Column:
    """The number a value stands for, or null: blanks around and underscores between digits are dropped."""
    s = F.trim(value)
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    joined = F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")
    low = F.lower(s)
    x = (F.when(s.rlike(shape), s.try_cast("double")).when(s.contains("_") & joined.rlike(shape), joined.try_cast("double"))
          .when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))))
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def value_ranks(p: Profile) -> DataFrame:
    """value, rank over all columns: numbers before texts; values of one number share their last place. NaN has none."""
    v = p.counts.select("value").distinct().where(~F.lower(F.trim("value")).isin("nan", "+nan", "-nan"))
    keyed = v.select("value", parsed_number(F.col("value")).alias("num"))
    ranked = global_rank(keyed, [F.col("num").isNull(), F.col("num"), F.col("value")])
    last = ranked.where(F.col("num").isNotNull()).groupBy("num").agg(F.max("rank").alias("rank"))
    return (ranked.where(F.col("num").isNotNull()).select("value", "num").join(last, "num").select("value", "rank")
                  .unionByName(ranked.where(F.col("num").isNull()).select("value", "rank")))


def column_ranks(p: Profile) -> DataFrame:
    """col_id, value, rank, n."""
    p = Profile(p.columns, materialize(p.counts, "counts"))  # read twice
    return p.counts.join(value_ranks(p), "value").select("col_id", "value", "rank", "n")


def running_counts(df: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """``df`` with ``upto``: the sum of ``n`` in its group up to and with this row, without a task per group."""
    placed = (df.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("__p", F.spark_partition_id()))
    local = materialize(placed.withColumn("__s", F.sum(n).over(Window.partitionBy("__p", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))), "running")
    per = local.groupBy(group, "__p").agg(F.sum(n).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and partition that holds it
    before = per.select(group, "__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"))
    return local.join(before, [group, "__p"]).withColumn("upto", F.col("__s") + F.col("__b")).drop("__p", "__s", "__b")


def quantiles(ranks: DataFrame, q: int) -> DataFrame:
    """col_id, i, boundary: linear interpolation at i / (q + 1) of the sorted ranks, repeats counted, unrounded."""
    per = ranks.groupBy("col_id", "rank").agg(F.sum("n").alias("n"))
    run = running_counts(per, "col_id", "rank", "n")
    length = per.groupBy("col_id").agg(F.sum("n").alias("len"))
    r = run.join(F.broadcast(length), "col_id").select("col_id", "rank", "len", (F.col("upto") - F.col("n")).alias("lo"), (F.col("upto") - 1).alias("hi"))
    one = r.where("len = 1").select("col_id", F.lit(1).alias("i"), F.col("rank").cast("double").alias("boundary"))
    d = q + 1

    def held(shift: int, name: str) -> DataFrame:  # the places i whose lower (upper) neighbour is in this run of equal ranks
        lo, hi = f"(lo - {shift})", f"(hi - {shift})"
        first = F.expr(f"greatest(1, CAST(ceil({lo} * {d} / (len - 1)) AS INT))")
        last = F.expr(f"least({q}, CAST((({hi} + 1) * {d} - 1) div (len - 1) AS INT))")
        return r.where("len > 1").withColumn("f", first).withColumn("l", last).where("f <= l").select("col_id", "len", F.explode(F.sequence("f", "l")).alias("i"), F.col("rank").alias(name))

    lower, upper = held(0, "low"), held(1, "high").drop("len")
    rest = F.expr(f"((len - 1) * i) % {d}")
    both = lower.join(upper, ["col_id", "i"]).select("col_id", "i", ((F.col("low") * (d - rest) + F.col("high") * rest) / d).alias("boundary"))
    return both.unionByName(one)


def histograms(ranks: DataFrame, q: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per column its smallest rank and its boundaries, rounded to 3 places as decimals are and without repeats.

    At most q numbers per column.
    """
    least = {r.col_id: r.m for r in ranks.groupBy("col_id").agg(F.min("rank").alias("m")).collect()}
    rows = quantiles(ranks, q).groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("i", "boundary"))).alias("b")).collect()
    out = {}
    for r in rows:
        bounds = list(dict.fromkeys(round(x.boundary, 3) for x in r.b))
        out[r.col_id] = (least[r.col_id], np.array(bounds))
    return out


def _cells(at: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"col_id": b["col_id"], "cell": np.searchsorted(at, b["rank"].to_numpy(dtype="float64"), side="left"), "n": b["n"]})

    return run


def count_between(ranks: DataFrame, at: np.ndarray) -> DataFrame:
    """col_id, cells: for each column how many of its ranks lie between which boundaries."""
    cells = ranks.select("col_id", "rank", "n").mapInPandas(_cells(at), "col_id int, cell long, n long").groupBy("col_id", "cell").agg(F.sum("n").alias("n"))
    return materialize(cells.groupBy("col_id").agg(F.collect_list(F.struct("cell", "n")).alias("cells")), "cells")


def _upto(cells, size: int) -> np.ndarray:
    """How many ranks of a column are at most each boundary."""
    counts = np.zeros(size + 1)
    for x in cells:
        counts[x["cell"]] += x["n"]
    return np.cumsum(counts)[:-1]


def _distances(at: np.ndarray, hist: dict[int, tuple[int, np.ndarray]], own: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b, cells in zip(batch["col_id"], batch["cells"]):
                upto = _upto(cells, len(at))
                out += [(a, int(b), emd(own[a], _mass(hist[a], at, upto))) for a in hist if a != b]
            yield pd.DataFrame(out, columns=["a", "b", "d"])

    return run


def emd(reference: np.ndarray, other: np.ndarray) -> float:
    """Area between the cumulative shares per boundary; infinite without mass."""
    if not other.sum():
        return float("inf")
    return float(np.abs(np.cumsum(reference / reference.sum() - other / other.sum())).sum() / len(reference))


def _mass(hist: tuple[int, np.ndarray], at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    m, b = hist
    points = np.append(m - 0.5, b)
    return np.diff(upto[np.searchsorted(at, points)])


def cutoff(distances: list[float], threshold: float) -> float:
    """The lower end of the first largest gap below the threshold."""
    values = sorted([*distances, threshold])
    best, found = 0.0, 0.0
    for lo, hi in zip(values, values[1:]):
        if hi > threshold:
            break
        if hi - lo > best:
            best, found = hi - lo, lo
    return found


def neighbours(d: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    n = len(d)
    out = set()
    for i in range(n):
        limit = cutoff([float(d[i, j]) for j in range(n) if j != i], threshold)
        out |= {(i, j) for j in range(n) if j != i and d[i, j] <= limit}
    return out


def bloom_size(n: int) -> tuple[int, int]:
    """(bits, hashes) of a filter for ``n`` values at 1 % false hits."""
    bits = int(-max(n, 1) * np.log(0.01) / np.log(2) ** 2)
    return max(bits, 1), int(max(1.0, np.floor(bits / max(n, 1) * np.log(2))))


def bloom_index(value: Column, seed: Column, bits: Column) -> Column:
    """The bit of a value: first 8 bytes of SHA-256 of 'seed:value', modulo the bits."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), value), 256), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % bits).cast("long")


def shared_ranks(ranks: DataFrame, cols: list[int], bloom: bool) -> DataFrame:
    """a, b, rank, n: the values of a that b holds (or its Bloom filter claims to), with a's repeats."""
    mine = ranks.where(F.col("col_id").isin(cols))
    if not bloom:
        x = mine.select(F.col("col_id").alias("a"), "value", "rank", "n")
        y = mine.select(F.col("col_id").alias("b"), "value")
        return x.join(y, "value").where("a <> b").select("a", "b", "rank", "n")
    sizes = {r.col_id: bloom_size(r.n) for r in mine.groupBy("col_id").agg(F.sum("n").alias("n")).collect()}
    shape = F.broadcast(mine.sparkSession.createDataFrame([(c, *v) for c, v in sizes.items()], "b int, bits long, hashes int"))
    seeds = F.explode(F.sequence(F.lit(0), F.col("hashes") - 1))
    own = mine.select(F.col("col_id").alias("b"), "value").join(shape, "b").select("b", "bits", "value", seeds.alias("seed"))
    bits = own.select("b", bloom_index(F.col("value"), F.col("seed"), F.col("bits")).alias("bit")).distinct()
    asked = (mine.select(F.col("col_id").alias("a"), "value", "rank", "n").join(shape, F.col("a") != F.col("b"))
                 .select("a", "b", "bits", "hashes", "value", "rank", "n", seeds.alias("seed"))
                 .select("a", "b", "hashes", "value", "rank", "n", bloom_index(F.col("value"), F.col("seed"), F.col("bits")).alias("bit")))
    hit = asked.join(bits, ["b", "bit"]).groupBy("a", "b", "value", "rank", "n", "hashes").agg(F.count(F.lit(1)).alias("h")).where("h = hashes")
    return hit.select("a", "b", "rank", "n")


def _binned(hist: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for a, g in b.groupby("h"):
                m, bounds = hist[int(a)]
                x = g["rank"].to_numpy(dtype="float64")
                k = np.searchsorted(bounds, x, side="left")
                keep = (x >= m) & (k < len(bounds))
                parts.append(g.assign(bin=k)[keep])
            if parts:
                yield pd.concat(parts)[["h", "a", "b", "bin", "n"]]

    return run


def intersection_distances(ranks: DataFrame, cols: list[int], hist: dict[int, tuple[int, np.ndarray]], bloom: bool = False) -> np.ndarray:
    """Mean over both directions of the EMD between a column and its part shared with the other."""
    shared = materialize(shared_ranks(ranks, cols, bloom), "shared")
    # the part (a, b) on the boundaries of a; with Bloom filters an empty part is replaced by the other one, so of b too
    both = shared.select(F.col("a").alias("h"), "a", "b", "rank", "n")
    if bloom:
        both = both.unionByName(shared.select(F.col("b").alias("h"), "a", "b", "rank", "n"))
    rows = both.mapInPandas(_binned(hist), "h int, a int, b int, bin long, n long").groupBy("h", "a", "b", "bin").agg(F.sum("n").alias("n")).collect()
    mass: dict[tuple[int, int, int], np.ndarray] = {}
    for r in rows:
        mass.setdefault((r.h, r.a, r.b), np.zeros(len(hist[r.h][1])))[r.bin] += r.n
    any_ = {(r.a, r.b) for r in shared.select("a", "b").distinct().collect()} if bloom else set()
    own = _own_mass(ranks, cols, hist)
    n = len(cols)
    d = np.full((n, n), np.inf)
    for i in range(n):
        for j in range(i + 1, n):
            a, b = cols[i], cols[j]
            part_a = mass.get((a, a, b)) if not bloom or (a, b) in any_ else mass.get((a, b, a))
            part_b = mass.get((b, b, a)) if not bloom or (b, a) in any_ else mass.get((b, a, b))
            x = float("inf") if part_a is None else emd(own[a], part_a)
            y = float("inf") if part_b is None else emd(own[b], part_b)
            d[i, j] = d[j, i] = (x + y) / 2
    return d


def _own_mass(ranks: DataFrame, cols: list[int], hist: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    mine = ranks.where(F.col("col_id").isin(cols)).select(F.col("col_id").alias("h"), F.col("col_id").alias("a"), F.col("col_id").alias("b"), "rank", "n")
    out = {c: np.zeros(len(hist[c][1])) for c in cols}
    for r in mine.mapInPandas(_binned(hist), "h int, a int, b int, bin long, n long").groupBy("h", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.h][r.bin] += r.n
    return out


def distances(ranks: DataFrame, q: int) -> tuple[list[int], dict[int, tuple[int, np.ndarray]], np.ndarray]:
    """(columns with values, histograms, directed EMD matrix [reference, other])."""
    hist = histograms(ranks, q)
    cols = sorted(hist)
    if len(cols) < 2:
        return cols, hist, np.zeros((len(cols), len(cols)))
    at = np.unique(np.concatenate([np.append(b, m - 0.5) for m, b in hist.values()]))
    counted = count_between(ranks, at)
    own = _own_mass(ranks, cols, hist)
    place, d = {c: i for i, c in enumerate(cols)}, np.full((len(cols), len(cols)), np.inf)
    spread_out = counted.repartition(min(len(cols), 4 * counted.sparkSession.sparkContext.defaultParallelism))
    for r in spread_out.mapInPandas(_distances(at, hist, own), "a int, b int, d double").collect():
        d[place[r.a], place[r.b]] = r.d
    return cols, hist, d


def mirrored(d: np.ndarray) -> np.ndarray:
    """Only the direction from the earlier column counts, for both."""
    up = np.triu(d, 1)
    out = up + up.T
    np.fill_diagonal(out, np.inf)
    return out


def distribution_based(p: Profile, threshold1: float = 0.15, threshold2: float = 0.15, q: int = 256, bloom: bool = False, limits: WorkLimits | None = None) -> DataFrame:
    """The matcher: named pairs of columns that end in one cluster, score 1 / (1 + EMD)."""
    if not 0 <= threshold1 <= 1 or not 0 <= threshold2 <= 1 or q < 1:
        raise InvalidConfig("thresholds are between 0 and 1, quantiles at least 1")
    spark = p.counts.sparkSession
    named = "source_table string, source_column string, target_table string, target_column string, score double"
    ranks = materialize(column_ranks(p), "columns")
    if limits is not None:
        n = ranks.select("col_id").distinct().count()
        check_work("distance matrix", n * n if n > 1 else 0, limits.max_matrix_cells)
    cols, hist, d = distances(ranks, q)
    if len(cols) < 2:
        return spark.createDataFrame([], named)
    info = {c.col_id: c for c in p.columns}
    out = []
    for part in components(len(cols), neighbours(mirrored(d), threshold1)):
        if len(part) < 2:
            continue
        part = sorted(part, key=lambda i: (info[cols[i]].table.encode(), info[cols[i]].column.encode()))
        ids = [cols[i] for i in part]
        if limits is not None:
            check_work("distance matrix", len(ids) ** 2, limits.max_matrix_cells)
        near = neighbours(intersection_distances(ranks, ids, hist, bloom), threshold2)
        after: dict[int, set[int]] = {}
        for i, j in near:
            after.setdefault(i, set()).add(j)
        positive = near | {(i, k) for i, j in near for k in after.get(j, ()) if i != k}
        for cluster in correlation_clusters(len(ids), positive, limits):
            for x, i in enumerate(cluster):
                for j in cluster[x + 1:]:
                    a, b = info[ids[i]], info[ids[j]]
                    if a.table_no == b.table_no:
                        continue
                    far = d[part[i], part[j]]
                    score = 1 / (1 + round(far, 12)) if np.isfinite(far) else 0.0
                    s, t = (a, b) if a.table_no < b.table_no else (b, a)
                    out.append((s.table, s.column, t.table, t.column, float(score)))
    return spark.createDataFrame(out, named)
