"""Matching columns of two catalogues that share no key, each with a confidence.

1. Equal records of a side become one class.
2. A record gives blocking keys: its table's distinguishing part, rare name words,
   values, pairs of days, and code or range patterns with a name word. Keys held by
   few records bring them together; a key held by many grows by further marks of the
   record until few hold the combination. Pairs that share just a frequent combination
   meet in blocks where that can be evidence enough: no pair of log-odds >= 0 is missed.
3. Evidence on values, table, name, pattern and kind adds up to a pair's log-odds.
4. Pairs within a side of high probability are listings of one column: clusters.
5. Loopy belief propagation over the cluster pairs with a one-to-one factor at each
   cluster: messages are exchanged through joins with grouped sums until they settle.
6. A matched pair of clusters gives a pair for each listing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmatch.llm.columns import kind_of, name_tokens, pattern_keys, table_keys, value_keys
from colmatch.plans.shared import materialize, spread

_TOLD = ("rec long, side int, tables array<string>, known array<string>, other array<string>, vals array<string>, days array<string>, "
         "patterns array<string>, kind string, keys array<string>")


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for rec, side, table, name, dtype, samples in b.itertuples(index=False):
            samples = list(samples) if samples is not None else []
            keys = sorted({k for v in samples for k in value_keys(v)})
            known, other = name_tokens(name)
            tables, patterns = table_keys(table), pattern_keys(samples, keys)
            days = [k for k in keys if k[0] == "d"]
            vals = [k for k in keys if k[0] in "nst"]
            blocks = ["T" + t for t in tables] + ["o" + t for t in other] + ["v" + v for v in vals]
            blocks += [f"P{p} {w}" for p in patterns for w in known]
            blocks += [f"D{x}{y}" for i, x in enumerate(days) for y in days[i + 1:]]
            out.append((rec, side, tables, known, other, vals, days, patterns, kind_of(dtype, keys), sorted(set(blocks))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _TOLD.split(", ")])


def _bound(combo: Column) -> Column:
    """The most log-odds of a pair that shares the marks of ``combo`` only, missing names and tables being no evidence."""
    n = lambda kind: F.size(F.filter(combo, lambda m: F.substring(m, 1, 1) == kind))
    if_any = lambda kind, points: F.when(n(kind) > 0, points).otherwise(0.0)
    vals = F.when(n("v") > 0, F.least(4.0 * n("v") - 1, F.lit(20.0))).otherwise(0.0)
    days = F.when(n("D") > 0, F.least(3.0 * F.ceil((1 + F.sqrt(1 + 8.0 * n("D"))) / 2) - 4, F.lit(20.0))).otherwise(0.0)
    return F.lit(-7.0 + 0.5) + vals + days + if_any("T", 8.0) + if_any("o", 6.0) + if_any("w", 4.0) + if_any("p", 5.0)


def _way(combo: Column, deep: int) -> Column:
    """How pairs that share no more than a frequent combination can reach log-odds of 0.

    'none': in no way; 'bare', 'stray', 'either': only if a record has no known name
    word, no table, or one of both, as differing ones cost 6 and 8; 'whole': any can.
    """
    most, has = _bound(combo), lambda kind: F.exists(combo, lambda m: F.substring(m, 1, 1) == kind)
    return (F.when(F.size(combo) >= deep, "whole").when(most < 0, "none").when(~has("w") & (most < 6), "bare").when(~has("T") & (most < 8), "stray")
             .when(~has("w") & ~has("T") & (most < 14), "either").otherwise("whole"))


def _frequent(told: DataFrame, hot: DataFrame, few: int, deep: int, block: int) -> DataFrame:
    """a, b: pairs that share keys held by many; every pair of log-odds >= 0 among them.

    ``hot``: rec, k. A frequent combination of marks (keys, name words, patterns) grows
    by each further mark of a record until few hold it. Pairs that share nothing more
    are lost by growing, so those that could reach log-odds of 0 meet beforehand in
    blocks of ``block`` x ``block`` records and are scored where they meet.
    """
    mark = lambda kind, x: F.concat(kind, F.xxhash64(x).cast("string"))
    first, parts = F.substring("k", 1, 1), F.split(F.expr("substring(k, 2)"), " ")
    single = F.when(first != "P", mark(first, F.col("k")))
    start = hot.select("rec", F.when(first == "P", F.array_sort(F.array(mark(F.lit("p"), parts[0]), mark(F.lit("w"), parts[1])))).otherwise(F.array(single)).alias("combo"))
    held = hot.groupBy("rec").agg(F.collect_set(single).alias("marks"))
    own = told.drop("keys").join(held, "rec").withColumn("marks", F.concat(
        "marks", F.transform("patterns", lambda x: mark(F.lit("p"), x)), F.transform("known", lambda x: mark(F.lit("w"), x))))
    own = materialize(own, "marks")
    level, small, large = materialize(start, "combos"), [], []
    while not level.isEmpty():
        n = level.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counted = materialize(level.join(n, "combo").withColumn("key", F.xxhash64("combo")).withColumn("way", _way(F.col("combo"), deep)), "counted")
        small.append(counted.where(F.col("n") <= few).select("rec", "key"))
        many = counted.where(F.col("n") > few)
        large.append(many.where("way <> 'none'").select("rec", "key", "n", "way"))
        grown = (many.where("way <> 'whole'").join(own.select("rec", "marks"), "rec")
                     .select("rec", "combo", F.explode(F.array_except("marks", "combo")).alias("m")).select("rec", F.array_sort(F.array_append("combo", F.col("m"))).alias("combo")))
        level = materialize(grown.distinct(), "combos")
    if not small:
        return _meet(hot.select("rec", F.xxhash64("k").alias("key")))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    big = union(large).join(own.drop("marks"), "rec").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    bare, stray = F.size("known") == 0, F.size("tables") == 0
    free = F.when(F.col("way") == "bare", bare).when(F.col("way") == "stray", stray).when(F.col("way") == "either", bare | stray).otherwise(True)
    big = materialize(big.withColumn("free", free).withColumn("here", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int")), "frequent")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    facts = [c for c in told.columns if c not in ("keys", "rec")]
    x = big.where("free").select("key", F.col("here").alias("i"), every.alias("j"), F.col("rec").alias("a"), *(F.col(c).alias(f"{c}_a") for c in facts))
    y = big.select("key", every.alias("i"), F.col("here").alias("j"), F.col("rec").alias("b"), "free", *(F.col(c).alias(f"{c}_b") for c in facts))
    met = x.join(y, ["key", "i", "j"]).where((F.col("a") != F.col("b")) & (~F.col("free") | (F.col("a") < F.col("b"))) & (_log_odds() > -6))
    return _meet(union(small)).unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _meet(keys: DataFrame) -> DataFrame:
    """a, b (a < b): records (rec) with the same key."""
    x, y = keys.alias("x"), keys.alias("y")
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rec") < F.col("y.rec")))
             .select(F.col("x.rec").alias("a"), F.col("y.rec").alias("b")))


def _blocked(told: DataFrame, few: int, deep: int = 4, block: int = 1024) -> DataFrame:
    """a, b (a < b): records that share a key held by at most ``few``, or frequent keys and may be one column."""
    keyed = materialize(told.select("rec", F.explode("keys").alias("k")).select("rec", F.xxhash64("k").alias("key")), "keys")
    counts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    rare = keyed.join(counts.where(F.col("n") <= few), "key").select("rec", "key")
    often = counts.where(F.col("n") > few).select("key")
    hot = materialize(told.select("rec", F.explode("keys").alias("k")).withColumn("key", F.xxhash64("k")).join(often, "key").select("rec", "k"), "hot")
    return _meet(rare).unionByName(_frequent(told, hot, few, deep, block)).distinct()


def _log_odds():
    """The evidence of a pair, from columns of both records with suffixes _a and _b."""
    shared = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    filled = lambda c: (F.size(f"{c}_a") > 0) & (F.size(f"{c}_b") > 0)
    vals = F.when(shared("vals") > 0, F.least(4.0 * shared("vals") - 1, F.lit(20.0))).when(filled("vals"), -1.0).otherwise(0.0)
    days = F.when(shared("days") > 1, F.least(3.0 * shared("days") - 4, F.lit(20.0))).when(filled("days"), -1.0).otherwise(0.0)
    table = F.when(shared("tables") > 0, 8.0).when(filled("tables"), -8.0).otherwise(0.0)
    other = (F.when(shared("other") > 0, 6.0).when(filled("other"), -4.0)
              .when((F.size("other_a") > 0) | (F.size("other_b") > 0), -2.0).otherwise(0.0))
    alike = shared("known") / F.greatest(F.lit(1), F.least(F.size("known_a"), F.size("known_b")))
    same = F.size(F.array_union("known_a", "known_b")) == shared("known")
    known = F.when(~filled("known"), 0.0).when(same, 4.0).when(alike > 0.6, 3.0).when(alike >= 0.5, 0.5).when(alike > 0.3, -2.0).otherwise(-6.0)
    pattern = F.when(shared("patterns") > 0, 5.0).when(filled("patterns"), -4.0).otherwise(0.0)
    sampled = ((F.size("vals_a") + F.size("days_a")) > 0) & ((F.size("vals_b") + F.size("days_b")) > 0)
    kind = F.when((F.col("kind_a") == F.col("kind_b")) & (F.col("kind_a") != "u"), 0.5).when(sampled, -3.0).otherwise(0.0)
    return F.lit(-7.0) + vals + days + table + other + known + pattern + kind


def _clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rec, cluster: the least record that links lead to; labels spread until they rest."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = both.select(F.col("a").alias("rec")).distinct().withColumn("cluster", F.col("rec"))
    while True:
        near = both.join(label, both.b == label.rec).groupBy("a").agg(F.min("cluster").alias("near")).withColumnRenamed("a", "rec")
        new = materialize(label.join(near, "rec").select("rec", F.least("cluster", "near").alias("cluster"), (F.col("near") < F.col("cluster")).alias("moved")), "labels")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return nodes.join(label, "rec", "left").select("rec", "side", F.coalesce("cluster", "rec").alias("cluster"))


def propagate(pairs: DataFrame, rounds: int = 100, settled: float = 1e-3, damping: float = 0.25) -> DataFrame:
    """l, r, belief, settled: marginal probability of each candidate under one-to-one factors.

    ``pairs``: l, r, theta (log-odds). Pairs without a rival are exact at once; the
    others exchange messages: a side's factor tells a pair -log(1 + sum of the
    exponentials of its rivals' messages). The sums are aggregates by side, joined
    back, so a node of very many pairs is no task of its own. Damping grows halfway
    to 1 every 20 rounds; ``settled`` is false for pairs whose messages still change
    by more than ``settled`` after ``rounds``.
    """
    sides = lambda df, total: df.join(total("l"), "l").join(total("r"), "r")
    start = materialize(sides(pairs, lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}"))), "rivals")
    sure = lambda x: 1 / (1 + F.exp(-x))
    alone = start.where("n_l = 1 and n_r = 1").select("l", "r", sure(F.col("theta")).alias("belief"), F.lit(True).alias("settled"))
    zero = F.lit(0.0)
    state = start.where("n_l > 1 or n_r > 1").select("l", "r", "theta", zero.alias("from_l"), zero.alias("from_r"), F.lit(float("inf")).alias("change"))
    for turn in range(rounds):
        keep = 1 - (1 - damping) / 2 ** (turn // 20)
        told = state.withColumn("e_l", F.exp(F.col("theta") + F.col("from_r"))).withColumn("e_r", F.exp(F.col("theta") + F.col("from_l")))
        met = sides(told, lambda c: told.groupBy(c).agg(F.sum(f"e_{c}").alias(f"s_{c}")))
        new = lambda c: -F.log1p(F.greatest(F.col(f"s_{c}") - F.col(f"e_{c}"), zero))
        mix = lambda c: F.lit(keep) * F.col(f"from_{c}") + F.lit(1 - keep) * new(c)
        change = F.greatest(*(F.abs(new(c) - F.col(f"from_{c}")) for c in "lr"))
        state = materialize(met.select("l", "r", "theta", mix("l").alias("from_l"), mix("r").alias("from_r"), change.alias("change")), "messages")
        most = state.agg(F.max("change")).first()[0]
        if most is None or most < settled:
            break
    found = state.select("l", "r", sure(F.col("theta") + F.col("from_l") + F.col("from_r")).alias("belief"), (F.col("change") < settled).alias("settled"))
    return alone.unionByName(found)


def match_columns(left: DataFrame, right: DataFrame, few: int = 64, same_listing: float = 4.0, least: float = 0.5) -> DataFrame:
    """left_id, right_id, confidence, settled of the rows that describe one column.

    ``left`` and ``right``: id, table_name, name, data_type, samples. Null names,
    tables and samples are no evidence; a row with nothing but a common name matches
    nothing; repeated rows give a pair each; an empty side gives no rows. ``settled``
    is false where messages had not come to rest, see ``propagate``.
    """
    side = lambda df, s: df.select(F.col("id"), F.lit(s).alias("side"), "table_name", "name", "data_type", "samples")
    rows = side(left, 0).unionByName(side(right, 1))
    content = F.xxhash64("side", F.to_json(F.struct("table_name", "name", "data_type", "samples")))
    rows = rows.withColumn("rec", content)
    classes = rows.groupBy("rec").agg(F.min("side").alias("side"), *(F.min_by(c, "id").alias(c) for c in ("table_name", "name", "data_type", "samples")))
    told = materialize(spread(classes.select("rec", "side", "table_name", "name", "data_type", "samples")).mapInPandas(_describe, _TOLD), "told")
    facts = told.drop("keys")
    of = lambda s: facts.select(*(F.col(c).alias("a" if s == "a" and c == "rec" else "b" if c == "rec" else f"{c}_{s}") for c in facts.columns))
    scored = (_blocked(told, few).join(of("a"), "a").join(of("b"), "b")
              .select("a", "b", "side_a", "side_b", _log_odds().alias("theta")).where("theta > -6"))
    scored = materialize(scored, "scored")
    cluster = materialize(_clusters(facts.select("rec", "side"), scored.where(F.col("side_a") == F.col("side_b")).where(F.col("theta") >= same_listing)), "clusters")
    across = scored.where(F.col("side_a") != F.col("side_b")).select(
        F.when(F.col("side_a") == 0, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("side_a") == 0, F.col("b")).otherwise(F.col("a")).alias("y"), "theta")
    named = lambda c, n: cluster.select(F.col("rec").alias(c), F.col("cluster").alias(n))
    pairs = across.join(named("x", "l"), "x").join(named("y", "r"), "y").groupBy("l", "r").agg(F.max("theta").alias("theta"))
    found = propagate(pairs).where(F.col("belief") >= least)
    members = rows.select("id", "rec").join(cluster, "rec")
    return (found.join(members.where("side = 0").select(F.col("cluster").alias("l"), F.col("id").alias("left_id")), "l")
                 .join(members.where("side = 1").select(F.col("cluster").alias("r"), F.col("id").alias("right_id")), "r")
                 .select("left_id", "right_id", F.round("belief", 6).alias("confidence"), "settled"))
