"""Filling containers of fixed capacity with items, cutting only what exceeds it.

An item above the capacity fills whole containers with its first pieces; only its
remainder is packed. Items are dealt to shards by the hash of their id, so a shard
has a fixed expected size and no key can make it large. A shard is packed best-fit
decreasing and improved by local search: documents are moved, exchanged one for one
or two for one between underfull containers as long as the sum of squared fills
grows, the emptiest container giving, until it is empty or no exchange is left; every
step looks at all items of the shard. Containers that stay underfull are dealt anew
with those of other shards and searched again until no turn saves a container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmatch.plans.shared import materialize

PLACED = "budget_id int, container string, id long, piece long, start long, size long, fill long"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item indexes; each item goes where it leaves least space."""
    room: list[tuple[int, int]] = []  # (space left, container), sorted
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(out)
            out.append([])
        out[b].append(i)
        insort(room, (left - sizes[i], b))
    return out


class _Bins:
    """Items in containers, with the items sorted by (container, size) for searches over all of them."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.size, self.capacity = np.asarray(sizes, dtype=np.int64), capacity
        self.home = np.full(len(sizes), -1, dtype=np.int64)
        for b, items in enumerate(bins):
            self.home[items] = b
        self.fill = np.zeros(len(bins), dtype=np.int64)
        np.add.at(self.fill, self.home[self.home >= 0], self.size[self.home >= 0])
        self.content = [set(b) for b in bins]
        self.sort()

    def sort(self) -> None:
        self.order = np.lexsort((self.size, self.home))
        self.key = self.home[self.order] * (self.capacity + 1) + self.size[self.order]

    def shift(self, i: int, b: int) -> None:
        a = self.home[i]
        self.content[a].discard(i)
        self.content[b].add(i)
        self.fill[a] -= self.size[i]
        self.fill[b] += self.size[i]
        self.home[i] = b

    def move(self, i: int) -> bool:
        """Item ``i`` to the fullest container that takes it, if that raises the squared fill."""
        y = self.home[i]
        fits = (self.fill + self.size[i] <= self.capacity) & (self.fill > self.fill[y] - self.size[i])
        fits[y] = False
        if not fits.any():
            return False
        self.shift(i, int(np.argmax(np.where(fits, self.fill, -1))))
        return True

    def swap(self, i: int) -> bool:
        """Item ``i`` for the one or two smaller items of a container that is then filled most."""
        y, s = self.home[i], self.size[i]
        home, size = self.home[self.order], self.size[self.order]
        space = self.capacity - self.fill[home]
        fuller = (home != y) & (space > 0)
        gain = np.where(fuller, s - size, 0)  # for one
        ok = (gain > 0) & (gain <= space) & (self.fill[home] + gain > self.fill[y])
        one = np.where(ok, gain - space, -self.capacity - 1)
        # for two: with each item the largest other one of its container that leaves less than s together
        at = np.searchsorted(self.key, home * (self.capacity + 1) + np.maximum(s - 1 - size, -1), side="right") - 1
        at = np.where(at == np.arange(len(at)), at - 1, at)
        there = (at >= 0) & (home[at] == home)
        both = size + size[at]
        gain = np.where(fuller & there, s - both, 0)
        ok = (gain > 0) & (gain <= space) & (self.fill[home] + gain > self.fill[y])
        two = np.where(ok, gain - space, -self.capacity - 1)
        j, k = int(np.argmax(one)), int(np.argmax(two))
        if max(one[j], two[k]) < -self.capacity:
            return False
        out, b = ([j], home[j]) if one[j] >= two[k] else ([k, int(at[k])], home[k])
        for x in self.order[out]:
            self.shift(int(x), int(y))
        self.shift(i, int(b))
        return True


def improve(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty the emptiest containers by moves and exchanges that raise the sum of squared fills.

    Each container gives, the emptiest first, until no item of it can go: every step
    looks at all items of all underfull containers and raises the sum, so it ends.
    Items without size follow into a container that stays.
    """
    t = _Bins(sizes, bins, capacity)
    closed = np.zeros(len(bins), dtype=bool)  # emptied, or given up as giver
    while True:
        givers = np.flatnonzero(~closed & (t.fill > 0) & (t.fill < capacity))
        if len(givers) < 2:
            break
        y = int(givers[np.argmin(t.fill[givers])])
        while t.fill[y]:
            items = sorted((i for i in t.content[y] if t.size[i]), key=lambda k: (-t.size[k], k))
            if not (any(t.move(i) for i in items) or any(t.swap(i) for i in items if t.size[i] > 1)):
                break
            t.sort()
        closed[y] = True
    used = [b for b in range(len(bins)) if t.fill[b]] or [0]
    for b, c in enumerate(t.content):
        if c and not t.fill[b] and b != used[0]:
            t.content[used[0]] |= c
            t.content[b] = set()
    return [sorted(c) for c in t.content if c]


def _place(pdf: pd.DataFrame, bins: list[list[int]], label: str) -> pd.DataFrame:
    rows = [(k, n) for n, items in enumerate(bins) for k in items]
    out = pdf.iloc[[k for k, _ in rows]][["budget_id", "id", "piece", "start", "size"]].copy()
    number = [n for _, n in rows]
    out["container"] = [f"{label}-{n}" for n in number]
    out["fill"] = out["size"].groupby(number).transform("sum").to_numpy() if len(out) else []
    return out[["budget_id", "container", "id", "piece", "start", "size", "fill"]]


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    budget, shard = key
    pdf = pdf.sort_values(["id", "piece"], ignore_index=True)
    sizes, capacity = pdf["size"].tolist(), int(pdf["capacity"].iloc[0])
    return _place(pdf, improve(sizes, best_fit_decreasing(sizes, capacity), capacity), f"{budget}-a{shard}")


def _repack(turn: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        budget, group = key
        pdf = pdf.sort_values(["container", "id", "piece"], ignore_index=True)
        sizes, capacity = pdf["size"].tolist(), int(pdf["capacity"].iloc[0])
        bins = [list(map(int, g)) for g in pdf.groupby("container", sort=True).indices.values()]
        return _place(pdf, improve(sizes, bins, capacity), f"{budget}-r{turn}.{group}")

    return run


def pack(items: DataFrame, budgets: DataFrame, shard_items: int = 4_096, group_bins: int = 256, slack: float = 0.01, max_budgets: int = 1_000) -> DataFrame:
    """budget_id, container, id, piece, start, size, fill: every item in a container of each budget.

    ``items``: id, size; ``budgets``: budget_id, capacity (at most ``max_budgets``, else an error). ``start``
    is where a piece begins in its item, ``fill`` what its container holds. Items of
    null or no size take a place without space; capacities below 1 take nothing.
    ``shard_items`` and ``group_bins`` bound a task; a container counts as underfull
    when more than ``slack`` of it is free. Underfull ones are dealt anew as long as
    that needs fewer containers.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0))
    caps = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("long").alias("capacity")).where("capacity > 0")
    held = caps.limit(max_budgets + 1).collect()
    if len(held) > max_budgets:
        raise ValueError(f"more than {max_budgets} budgets")
    each = F.array(*(F.struct(F.lit(r.budget_id).cast("int").alias("budget_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in held)) if held else F.array().cast("array<struct<budget_id:int,capacity:bigint>>")
    wanted = items.select(F.col("id").cast("long").alias("id"), size.alias("whole"), F.inline(each))
    wanted = wanted.withColumn("cuts", F.expr("CASE WHEN whole > capacity THEN whole div capacity ELSE 0 END"))
    full = (wanted.where("cuts > 0").select("*", F.posexplode(F.sequence(F.lit(1), F.col("cuts"))).alias("piece", "_n"))
            .select("budget_id", F.concat_ws("-", "budget_id", F.lit("c"), "id", "piece").alias("container"), "id", F.col("piece").cast("long").alias("piece"),
                    (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"), F.col("capacity").alias("fill")))
    rest = wanted.select("budget_id", "capacity", "id", F.col("cuts").alias("piece"), (F.col("cuts") * F.col("capacity")).alias("start"), (F.col("whole") - F.col("cuts") * F.col("capacity")).alias("size")).where("size > 0 or piece = 0")
    shards = max(1, -(-items.count() // shard_items))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    caps = F.broadcast(caps)
    placed = materialize(dealt.groupBy("budget_id", "shard").applyInPandas(_pack, PLACED), "packed")
    done = []
    turn, bins = 0, None
    while True:
        whole = placed.join(caps, "budget_id")
        under = F.col("fill") < F.col("capacity") * (1 - slack)
        now = placed.select("container").distinct().count()
        if bins is not None and now >= bins:
            break
        open_ = whole.where(under)
        several = open_.select("container").distinct().count()
        if several < 2:
            break
        done.append(whole.where(~under).select(*placed.columns))
        group = F.pmod(F.xxhash64("container", F.lit(turn)), F.lit(max(1, -(-several // group_bins))))
        placed = materialize(open_.withColumn("group", group).groupBy("budget_id", "group").applyInPandas(_repack(turn), PLACED), "packed")
        turn, bins = turn + 1, several
    out = placed
    for d in done:
        out = out.unionByName(d)
    return out.unionByName(full)
