"""Values that have a similar one in another column: whole, equal to a plain walk, nothing of their size in the driver."""

import random

import numpy as np
import pytest

from colmatch.functions import batches
from colmatch.functions import expressions as X
from colmatch.functions.names import DISTANCES
from colmatch.operators import jaccard
from colmatch.sources import profile

BATCHED = ["levenshtein", "hamming", "damerau_levenshtein", "jaro", "jaro_winkler"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé\U0001F600") for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) for _ in range(n)]


@pytest.mark.parametrize("distance", BATCHED)
def test_batches_equal_plain_measures(distance):
    x, y = (np.array([*texts(k, 1500), "a" * 300, "CA", "a\0", "abcd"], dtype=object) for k in (3, 4))
    y[:700] = ["".join(random.Random(k).sample(v, len(v))) for k, v in enumerate(x[:700])]
    assert batches.similarities(distance, x, y).tolist() == [DISTANCES[distance](v, w) for v, w in zip(x, y)]


def test_a_value_with_a_partner_is_compared_with_few(monkeypatch):
    compared, measure = [], batches.similarities
    monkeypatch.setattr(batches, "similarities", lambda d, x, y: compared.append(len(x)) or measure(d, x, y))
    rng = random.Random(6)
    x, y = (np.array([f"{name}#{rng.randrange(10 ** 6):09d}" for _ in range(3000)], dtype=object) for name in ("Customer", "Supplier"))
    assert batches.partnered("jaro_winkler", 0.65, x, y).all() and sum(compared) < 10 * len(x)


def tables(spark):
    return profile.from_fields(spark, [("s", [("x", "text", texts(1, 60)), ("w", "text", ["zzzzzzzzzzzzzzzzzzzz"])]), ("t", [("y", "text", texts(2, 40)), ("v", "text", [])]), ("u", [("z", "text", ["abc", "cab"])])])


@pytest.mark.parametrize("distance", BATCHED)
def test_values_are_never_broadcast(spark, monkeypatch, distance):
    plans, write = [], jaccard.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: plans.append(plan(df)) or write(df, label))
    plans.append(plan(jaccard.matched_values(tables(spark), distance, 0.5, block=8)))
    assert len(plans) > 1 and not any("Broadcast" in x for x in plans)


@pytest.mark.parametrize("distance", BATCHED)
def test_partners_in_any_block(spark, distance):
    p, measure, cut = tables(spark), DISTANCES[distance], X.float_cutoff(0.6)
    held = {}
    for r in p.counts.collect():
        held.setdefault(r.col_id, set()).add(r.value)
    table = {c.col_id: c.table_no for c in p.columns}
    want = {(v, d) for c in held for v in held[c] for d in held if table[c] != table[d] and any(measure(v, y) >= cut for y in held[d])}
    for block in (4096, 16):
        got = {(r.value, r.d) for r in jaccard.matched_values(p, distance, 0.6, block).collect()}
        own = {(v, d) for v, d in got if v in held[d]}  # equal values need no comparison
        assert got - own == want - own, block
