"""Correlation clustering of a small directed graph, exactly.

Joined arcs must be transitive. The cost counts positive arcs that are not joined
and joined arcs that are not positive. Graphs of disjoint cliques cost nothing and
are recognised at once. Otherwise a broken chain u-v-w without u-w is mended in its
three ways, depth first, bounded by the least number of arc-disjoint broken chains.
"""

from __future__ import annotations

from colmatch.functions.types import AlgorithmError, WorkLimits, check_work


def components(n: int, arcs: set[tuple[int, int]]) -> list[list[int]]:
    """Connected components of the undirected graph, each sorted, by smallest member."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in arcs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i in range(n):
        out.setdefault(root(i), []).append(i)
    return [out[k] for k in sorted(out)]


def _broken(n: int, arcs: set[tuple[int, int]]):
    after: list[list[int]] = [[] for _ in range(n)]
    for u, v in sorted(arcs):
        after[u].append(v)
    for u in range(n):
        for v in after[u]:
            for w in after[v]:
                if w != u and (u, w) not in arcs:
                    yield u, v, w


def transitive(n: int, positive: set[tuple[int, int]], max_steps: int = 200_000) -> tuple[int, set[tuple[int, int]]]:
    """(cost, joined arcs) of least cost."""
    best: list = [len(positive), set()]
    steps = 0

    def bound(arcs: set, fixed: set) -> int:
        used: set = set()
        count = 0
        for u, v, w in _broken(n, arcs):
            three = {(u, v), (v, w), (u, w)}
            if not three & used:
                used |= three
                count += 1
        return count

    def search(arcs: set, fixed: set, cost: int) -> None:
        nonlocal steps
        steps += 1
        if steps > max_steps:
            raise AlgorithmError("correlation clustering: too many conflicts to solve exactly")
        if cost + bound(arcs, fixed) >= best[0]:
            return
        chain = next(_broken(n, arcs), None)
        if chain is None:
            best[0], best[1] = cost, set(arcs)
            return
        u, v, w = chain
        for arc, there in (((u, v), True), ((v, w), True), ((u, w), False)):
            if arc in fixed:
                continue
            changed = arcs - {arc} if there else arcs | {arc}
            search(changed, fixed | {arc}, cost + 1)

    search(set(positive), set(), 0)
    return best[0], best[1]


def correlation_clusters(n: int, positive: set[tuple[int, int]], limits: WorkLimits | None = None) -> list[list[int]]:
    """Clusters of nodes 0 to n - 1."""
    parts = components(n, positive)
    if all((i, j) in positive for c in parts for i in c for j in c if i != j):
        return parts
    if limits is not None:
        check_work("clustering variables", n * (n - 1), limits.max_clustering_variables)
        check_work("clustering constraints", n * (n - 1) * max(n - 2, 0), limits.max_clustering_constraints)
    joined: set[tuple[int, int]] = set()
    for part in parts:  # no arc between parts is worth joining
        at = {v: i for i, v in enumerate(part)}
        _, arcs = transitive(len(part), {(at[u], at[v]) for u, v in positive if u in at and v in at})
        joined |= {(part[u], part[v]) for u, v in arcs}
    return components(n, joined)
