"""All pairs of records whose value sets overlap above a threshold.

Extended-prefix join. Copies first become one class. The tokens of a class are
ordered by how few classes hold them. Two sets that must share at least l tokens
share l ones among their first n - ceil(t n) + l. So a pair is found by the first
combination of its shared tokens, in that order, that few classes hold: one rare
token, or else the two first ones, as all that it shares is frequent, or else the
three first ones, and so on. Only combinations held by many grow, each by the later
tokens of the longer prefix; both records of a pair choose alike, because the choice
hangs on counts of combinations. Frequent tokens are counted apart by band of set
sizes, so a long list meets only lists that are long enough.

What can't grow has an exact way too: where the sizes of a pair ask for no more than
the l tokens of a frequent combination, whatever meets there by equal sizes is a pair;
and combinations that are still frequent at ``deep`` tokens, or at as many as keep a
set's combinations below ``most`` (one, for long lists), meet in blocks of ``block`` x
``block`` classes. Candidates are verified by their overlap; row pairs come from class
pairs at the end. Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce
from math import comb, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmatch.plans.shared import materialize, spread
from colmatch.plans.skew import join_counted


def value_set(samples: Column) -> Column:
    """The distinct samples in lower case without blanks at the ends, sorted; null and empty ones left out."""
    blank = r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$"
    clean = F.transform(samples, lambda s: F.lower(F.regexp_replace(s, blank, "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda s: s.isNotNull() & (s != ""))))


class _Sizes:
    """What a threshold of num / den asks of sets of n and m tokens."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def ceil(self, up: Column, down: int) -> Column:
        return F.floor((up + (down - 1)) / down).cast("int")

    def own(self, n: Column) -> Column:
        """The least overlap of a set of n tokens with any partner, and the least size of a partner."""
        return self.ceil(n * self.num, self.den)

    def largest(self, n: Column) -> Column:
        return F.floor(n * self.den / self.num).cast("int")

    def needed(self, n: Column, m: Column) -> Column:
        return self.ceil((n + m) * self.num, self.num + self.den)

    def prefix(self, n: Column, length: int) -> Column:
        return F.least(n, n - self.own(n) + length)

    def enough(self, overlap: Column, n: Column, m: Column) -> Column:
        return overlap * (self.num + self.den) >= (n + m) * self.num


def _wide(t: _Sizes) -> float:
    """The ratio of a band's ends: a little more than a pair's sizes may differ by, so that these never lie two bands apart."""
    return t.den / t.num * 1.001


def _last_part(t: _Sizes, short: int, length: int, most: int) -> int:
    """The last pair of bands whose sets have at most ``most`` combinations of ``length`` tokens in their prefix; -1 if none."""
    b = -1
    while comb(int(short * _wide(t) ** (b + 1) * (1 - t.num / t.den)) + length, length) <= most:
        b += 1
    return 2 * b


def _parts(n: Column, t: _Sizes, short: int) -> Column:
    """The pairs of size bands that a set of n tokens takes part in: 2b for b with b, 2b + 1 for b with b + 1."""
    wide = _wide(t)
    b = F.when(n <= short, 0).otherwise(1 + F.floor(F.log(n / short) / log(wide)).cast("int")).cast("int")
    return F.when((b == 0) & (t.largest(n) <= short), F.array(b)).when(b == 0, F.array(b, b + 1)).otherwise(F.array(2 * b - 1, 2 * b, 2 * b + 1))


def _met(x: DataFrame, y: DataFrame, on: list[str], t: _Sizes) -> DataFrame:
    """a, b: classes of the same key whose sizes and places leave room for enough overlap."""
    x, y = x.alias("x"), y.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on])
    most = F.col("x.l") + F.least(F.col("x.n") - F.col("x.last"), F.col("y.n") - F.col("y.last")) - 1  # the key's tokens and what follows them
    fits = F.least("x.n", "y.n") * t.den >= F.greatest("x.n", "y.n") * t.num
    return x.join(y, same & (F.col("x.cid") < F.col("y.cid")) & fits & t.enough(most, F.col("x.n"), F.col("y.n")))


def _blocks(keyed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on key, i and j of rows that hold ``c``, the rows of their key."""
    dealt = keyed.withColumn("__k", F.ceil(F.col("c") / block).cast("int")).withColumn("__h", F.pmod(F.xxhash64("cid"), F.col("__k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    rest = [c for c in dealt.columns if not c.startswith("__")]
    return dealt.select(*rest, F.col("__h").alias("i"), every.alias("j")), dealt.select(*rest, every.alias("i"), F.col("__h").alias("j"))


def similar_classes(classes: DataFrame, num: int = 3, den: int = 5, rare: int = 64, frequent: int = 256, deep: int = 3, block: int = 1024, short: int = 64, most: int = 4096) -> DataFrame:
    """a, b (class ids, a < b), overlap, for classes (cid, values) with Jaccard >= num / den.

    ``rare`` and ``frequent``: most holders of a token and of a combination at which
    they meet; ``deep``: most tokens of a combination; ``short``: the first band of
    sizes; ``most``: combinations of a set above which its band grows no further. They
    steer the way only, never what is found.
    """
    t, n = _Sizes(num, den), F.col("n")
    tokens = materialize(classes.select("cid", F.explode("values").alias("v")).select("cid", F.xxhash64("v").alias("tok")).distinct(), "tokens")
    counted = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = (join_counted(tokens, counted, "tok", "df", tokens.count())
              .groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("toks")))
    sets = materialize(ranked.select("cid", F.size("toks").alias("n"), "toks"), "sets")
    pairs = [sets.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)]
    if num >= den:  # only equal sets are that similar, and they are one class
        return pairs[0].withColumn("overlap", F.lit(0))
    first = F.transform(F.slice("toks", F.lit(1), t.prefix(n, 1)), lambda x, i: F.struct(x["df"].alias("df"), x["tok"].alias("tok"), i.cast("int").alias("last")))
    placed = sets.select("cid", "n", F.lit(1).alias("l"), F.inline(F.filter(first, lambda x: x["df"] > 1)))
    single = placed.where(F.col("df") <= rare).select("cid", "n", "l", F.col("tok").alias("key"), "last")
    small = [single]
    often = placed.where(F.col("df") > rare).select("cid", "n", "l", "tok", "last", F.explode(_parts(n, t, short)).alias("part"))
    level = materialize(often.select("cid", "n", "l", "part", F.xxhash64("part", "tok").alias("key"), "last"), "frequent")
    ids = [F.col("x.cid").alias("a"), F.col("y.cid").alias("b")]
    for length in range(1, deep + 1):
        rows = level.count()
        if not rows:
            break
        held = level.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counted = materialize(join_counted(level, held, "key", "c", rows), "combinations")
        small.append(counted.where(F.col("c") <= frequent).select("cid", "n", "l", "key", "last"))
        many = counted.where(F.col("c") > frequent)
        # sizes that ask for no more than these tokens: all that meet here are pairs
        sized = many.withColumn("m", F.explode(F.filter(F.sequence(t.own(n), F.greatest(t.own(n), t.largest(n))), lambda m: t.needed(n, m) <= length)))
        ends = materialize(sized.select("cid", "n", "l", "last", F.xxhash64("key", F.least("n", "m"), F.greatest("n", "m")).alias("key")), "ends")
        if not ends.isEmpty():
            sizes = ends.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            pairs.append(_met(*_blocks(join_counted(ends, sizes, "key", "c", ends.count()), block), ["key", "i", "j"], t).select(*ids))
        more = many.where(t.needed(n, t.largest(n)) > length)
        deeper = F.col("part") <= (_last_part(t, short, length + 1, most) if length < deep else -1)
        rest = materialize(more.where(~deeper), "rest")
        if not rest.isEmpty():
            if length == 1:  # lists too long for combinations: their pairs meet by many tokens and are verified once below
                pairs.append(_met(*_blocks(rest, block), ["key", "i", "j"], t).select(*ids))
            else:
                own = rest.join(sets.select("cid", F.transform("toks", lambda x: x["tok"]).alias("t")), "cid")
                there = _met(*_blocks(own, block), ["key", "i", "j"], t).withColumn("shared", F.array_intersect("x.t", "y.t"))
                once = F.get("shared", F.lit(length - 1)) == F.get("x.t", F.col("x.last"))  # a pair meets by all its combinations; the first one counts
                pairs.append(there.where(once & t.enough(F.size("shared"), F.col("x.n"), F.col("y.n"))).select(*ids))
        if length == deep:
            break
        ahead = F.transform(F.slice("toks", F.col("last") + 2, F.greatest(t.prefix(n, length + 1) - F.col("last") - 1, F.lit(0))), lambda x, i: F.struct(x["tok"].alias("tok"), (i + F.col("last") + 1).cast("int").alias("at")))
        grown = more.where(deeper).join(sets.select("cid", "toks"), "cid").select("cid", "n", "part", "key", F.inline(ahead))
        level = materialize(grown.select("cid", "n", F.lit(length + 1).alias("l"), "part", F.xxhash64("key", "tok").alias("key"), F.col("at").alias("last")), "frequent")
    keyed = reduce(DataFrame.unionByName, small)
    pairs.append(_met(keyed, keyed, ["l", "key"], t).select(*ids))
    met = reduce(DataFrame.unionByName, pairs).distinct()
    hashes = lambda side: sets.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.transform("toks", lambda x: x["tok"]).alias(f"t_{side}"))
    checked = met.join(hashes("a"), "a").join(hashes("b"), "b").withColumn("overlap", F.size(F.array_intersect("t_a", "t_b")))
    return checked.where(t.enough(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b", "overlap")


def similar_rows(df: DataFrame, id_col: str, block_col: str, samples: str, num: int = 3, den: int = 5, min_size: int = 3, **tuning: int) -> DataFrame:
    """a, b: ids (a < b) of rows with different ``block_col`` and Jaccard >= num / den.

    Sets with fewer than ``min_size`` values, null lists among them, match nothing;
    empty sets never do. A null ``block_col`` differs from any value and equals null.
    Equal sets of different blocks are pairs; rows of one block never meet, however
    many there are. Extra columns are ignored.
    """
    s = spread(df.select(id_col, block_col, samples)).select(F.col(id_col).alias("id"), F.to_json(F.struct(F.col(block_col))).alias("block"), value_set(F.col(samples)).alias("values")).where(F.size("values") >= max(min_size, 1))
    s = materialize(s.withColumn("cid", F.unhex(F.substring(F.sha2(F.to_json("values"), 256), 1, 32))), "values")
    classes = materialize(s.groupBy("cid").agg(F.first("values").alias("values")), "classes")
    members = s.select("cid", "block", "id")
    part = members.select("cid", "block").distinct()
    several = part.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    pairs = similar_classes(classes, num, den, **tuning).select("a", "b").unionByName(several)
    side = lambda x: part.select(F.col("cid").alias(x), F.col("block").alias(f"block_{x}"))
    blocks = (pairs.join(side("a"), "a").join(side("b"), "b")
              .where((F.col("block_a") != F.col("block_b")) & ((F.col("a") != F.col("b")) | (F.col("block_a") < F.col("block_b")))))
    of = lambda x: members.select(F.col("cid").alias(x), F.col("block").alias(f"block_{x}"), F.col("id").alias(f"id_{x}"))
    rows = blocks.join(of("a"), ["a", "block_a"]).join(of("b"), ["b", "block_b"])
    return rows.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
