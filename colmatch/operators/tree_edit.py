"""Minimum-cost edit scripts between nested schemas.

A schema is an unordered tree: a node has a name, a type and children (fields of
a struct, the element of an array). A field that keeps its path keeps its identity.
Of what is left, ``edit_script`` finds the cheapest set of adds, deletes, renames,
retypes and moves: all lost subtrees are matched with all new ones by one assignment
of least cost. A matched pair costs its rename within one parent, or its move (and
rename) to another, plus the distance below it; an unmatched subtree costs its size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

FORBIDDEN = 1e9
RETYPE, MOVE = 0.1, 1.0
_SEP = "\x1f"  # between the steps of a path while it is worked on; names may hold dots


@dataclass(frozen=True)
class Node:
    name: str
    type: str = ""
    children: tuple["Node", ...] = field(default=())

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    kind: str  # added, removed, renamed, retyped or moved
    before: str  # path, '' for an addition
    after: str  # path, '' for a removal


def from_struct(dtype, name: str = "") -> Node:
    """The tree of a Spark data type."""
    kind = dtype.typeName()
    if kind == "struct":
        return Node(name, "struct", tuple(from_struct(f.dataType, f.name) for f in dtype.fields))
    if kind == "array":
        return Node(name, "array", (from_struct(dtype.elementType, "[]"),))
    if kind == "map":
        return Node(name, "map", (from_struct(dtype.keyType, "key"), from_struct(dtype.valueType, "value")))
    return Node(name, dtype.simpleString())


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of least total cost (rows <= columns)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, done = [inf] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _kept(a: Node, b: Node, pa: str, pb: str, lost: list, new: list, script: list[Edit]) -> float:
    """The cost of retypes among fields that keep their path; what keeps none goes to ``lost`` and ``new``."""
    cost = 0.0
    if a.type != b.type:
        cost += RETYPE
        script.append(Edit("retyped", pa, pb))
    left = {}
    for y in b.children:
        left.setdefault(y.name, []).append(y)
    for x in a.children:
        if left.get(x.name):
            cost += _kept(x, left[x.name].pop(0), _join(pa, x.name), _join(pb, x.name), lost, new, script)
        else:
            lost.append((_join(pa, x.name), (pa, pb), x))
    rest = {id(y) for ys in left.values() for y in ys}
    new += [(_join(pb, y.name), (pa, pb), y) for y in b.children if id(y) in rest]
    return cost


def _distance(a: Node, b: Node, rename: Callable[[str, str, Node, Node], float], pa: str, pb: str) -> tuple[float, list[Edit]]:
    script: list[Edit] = []
    lost: list = []
    new: list = []
    cost = _kept(a, b, pa, pb, lost, new, script)
    n, m = len(lost), len(new)
    to, below = [m] * n, {}
    if n and m:
        grid = [[FORBIDDEN] * (n + m) for _ in range(n + m)]
        for i, (p, up, x) in enumerate(lost):
            for j, (q, over, y) in enumerate(new):
                own = 0.0 if x.name == y.name else rename(p, q, x, y)
                if up != over:
                    own += MOVE
                if own < FORBIDDEN and own < x.size() + y.size():
                    below[i, j] = _distance(x, y, rename, p, q)
                    grid[i][j] = own + below[i, j][0]
            grid[i][m + i] = x.size()
        for j, (_, _, y) in enumerate(new):
            grid[n + j][j] = y.size()
        for i in range(n, n + m):
            for j in range(m, n + m):
                grid[i][j] = 0.0
        to = assign(grid)[:n]
    for i, (p, up, x) in enumerate(lost):
        if (i, to[i]) in below:
            q, over, y = new[to[i]]
            cost += grid[i][to[i]]
            script.append(Edit("renamed" if up == over else "moved", p, q))
            script += below[i, to[i]][1]
        else:
            cost += x.size()
            script.append(Edit("removed", p, ""))
    taken = {j for i, j in enumerate(to) if (i, j) in below}
    for j, (q, _, y) in enumerate(new):
        if j not in taken:
            cost += y.size()
            script.append(Edit("added", "", q))
    return cost, script


def _join(path: str, name: str) -> str:
    return f"{path}{_SEP}{name}" if path else name


def edit_script(before: Node, after: Node, rename: Callable[[str, str, Node, Node], float] | None = None) -> tuple[float, list[Edit]]:
    """(cost, script) that turns ``before`` into ``after``; names of roots don't matter.

    ``rename(path before, path after, node, node)`` is the cost of renaming, at
    least FORBIDDEN where the two cannot be the same field. By default any rename
    within one type costs 1.5, a little less than a removal and an addition.
    """
    rename = rename or (lambda p, q, x, y: 1.5 if x.type == y.type else FORBIDDEN)
    cost, script = _distance(before, after, rename, "", "")
    return cost, [Edit(e.kind, e.before.replace(_SEP, "."), e.after.replace(_SEP, ".")) for e in script]
