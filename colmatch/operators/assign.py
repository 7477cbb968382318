"""Exact assignment on small score matrices.

Scores become integers of one common denominator, so sums and comparisons are
exact. A second, higher part of the cost counts pairs from the threshold up where a
method asks for most pairs first.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd

SOURCE, TARGET = ["source_table", "source_column"], ["target_table", "target_column"]


def least_cost(cost: list[list[int]]) -> list[int]:
    """The column of each row in an assignment of least total cost; rows must not exceed columns.

    Shortest augmenting paths on integers; the first of equal columns wins.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v = [0] * n, [0] * m
    row_of = [-1] * m
    for start in range(n):
        dist: list[int | None] = [None] * m
        before, done = [-1] * m, [False] * m
        i, base, end = start, 0, -1
        came = -1
        while end < 0:
            best, at = None, -1
            for j in range(m):
                if done[j]:
                    continue
                d = base + cost[i][j] - u[i] - v[j]
                if dist[j] is None or d < dist[j]:
                    dist[j], before[j] = d, came
                if best is None or dist[j] < best:
                    best, at = dist[j], j
            done[at], base = True, best
            if row_of[at] < 0:
                end = at
            else:
                i, came = row_of[at], at
        for j in range(m):
            if done[j] and j != end:
                u[row_of[j]] += base - dist[j]
                v[j] -= base - dist[j]
        u[start] += base
        j = end
        while j >= 0:
            k = before[j]
            row_of[j] = start if k < 0 else row_of[k]
            j = k
    out = [-1] * n
    for j, i in enumerate(row_of):
        if i >= 0:
            out[i] = j
    return out


def select(pairs: list[tuple[tuple, tuple, float]], method: str, threshold: float) -> list[tuple[tuple, tuple, float]]:
    """The chosen (source, target, score) triples."""
    rows, cols = sorted({s for s, _, _ in pairs}), sorted({t for _, t, _ in pairs})
    exact = [Fraction(x) for _, _, x in pairs]
    scale = max((f.denominator for f in exact), default=1)  # denominators are powers of two
    score = {(s, t): int(f * scale) for (s, t, _), f in zip(pairs, exact)}
    value = {(s, t): x for s, t, x in pairs}
    aware = method.endswith("_aware")
    bonus = sum(score.values()) + 1 if aware else 0

    def gain(s, t) -> int:
        p = score.get((s, t))
        if p is None:
            return 0
        if aware:
            return p + bonus if value[s, t] >= threshold else 0
        return p

    if method.startswith("hungarian"):
        size = max(len(rows), len(cols))
        grid = [[-gain(rows[i], cols[j]) if i < len(rows) and j < len(cols) else 0 for j in range(size)] for i in range(size)]
        at = [(i, j) for i, j in enumerate(least_cost(grid))]
    elif len(rows) <= len(cols):
        at = list(enumerate(least_cost([[-gain(s, t) for t in cols] for s in rows])))
    else:
        at = [(i, j) for j, i in enumerate(least_cost([[-gain(s, t) for s in rows] for t in cols]))]
    chosen = [(rows[i], cols[j]) for i, j in at if i < len(rows) and j < len(cols)]
    return [(s, t, value[s, t]) for s, t in chosen if (s, t) in value and value[s, t] >= threshold]


def grouped(method: str, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf[SOURCE].itertuples(index=False, name=None), pdf[TARGET].itertuples(index=False, name=None), pdf["score"]))
        return pd.DataFrame([(*s, *t, x) for s, t, x in select(pairs, method, threshold)], columns=[*SOURCE, *TARGET, "score"])

    return run
