"""Similarity flooding: schema graphs, their product, and a fixpoint per table pair.

Only names and types enter, so a table pair is one row; pairs are spread over the
cluster and each is iterated in an Arrow batch with index arrays.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmatch.functions.names import levenshtein_similarity, prefix_suffix, split_words
from colmatch.functions.types import InvalidConfig
from colmatch.sources.profile import Profile

# How types are called in schema graphs.
TYPE_NAMES = {"integer": "int", "float": "float", "decimal": "float", "date": "date", "timestamp": "date"}


@dataclass
class Graph:
    nodes: list[tuple[str, str]]  # (kind, text): kind "lit" or "id"
    edges: dict[tuple[int, int], str]  # (from, to): label; a later edge replaces an earlier one
    columns: list[tuple[int, str]]  # (node, column name)


def schema_graph(table: str, columns: list[tuple[str, str]]) -> Graph:
    """Nodes of table, columns, types and their literals; equal literals are one node."""
    index: dict[tuple[str, str], int] = {}
    nodes: list[tuple[str, str]] = []
    edges: dict[tuple[int, int], str] = {}

    def node(kind: str, text: str) -> int:
        if (kind, text) not in index:
            index[kind, text] = len(nodes)
            nodes.append((kind, text))
        return index[kind, text]

    fresh = iter(range(10 ** 9))
    new = lambda: node("id", f"n{next(fresh)}")
    t = new()
    edges[t, node("lit", table)] = "Name"
    edges[t, node("lit", "Table")] = "Type"
    cols = []
    for name, dtype in columns:
        c = new()
        edges[c, node("lit", "Column")] = "Type"
        edges[t, c] = "Column"
        edges[c, node("lit", name)] = "Name"
        kind = TYPE_NAMES.get(dtype, "varchar")
        literal = index.get(("lit", kind))
        owner = next((a for (a, b) in edges if b == literal), None) if literal is not None else None
        if owner is None:
            owner = new()
            edges[owner, node("lit", "ColumnType")] = "Type"
            edges[owner, node("lit", kind)] = "Name"
        edges[c, owner] = "SqlType"
        cols.append((c, name))
    return Graph(nodes, edges, cols)


def product_weights(g: Graph, h: Graph, policy: str = "inverse_average") -> tuple[list[int], list[tuple[int, int, float]]]:
    """Product nodes and weighted edges (from, to, weight) of the propagation graph.

    A product node is its two nodes' places, first times the second graph's size plus
    second. Weights of incoming neighbours come first; outgoing ones replace them.
    """
    width = len(h.nodes)
    by_label: dict[str, list[tuple[int, int]]] = {}
    for (u, v), label in h.edges.items():
        by_label.setdefault(label, []).append((u, v))
    degree: dict[tuple, int] = {}
    for which, graph in ((0, g), (1, h)):
        for (u, v), label in graph.edges.items():
            degree[which, u, label, "out"] = degree.get((which, u, label, "out"), 0) + 1
            degree[which, v, label, "in"] = degree.get((which, v, label, "in"), 0) + 1

    def weight(a: int, b: int, label: str, way: str) -> float:
        x, y = degree[0, a, label, way], degree[1, b, label, way]
        return 2 / (x + y) if policy == "inverse_average" else 1 / (x * y)

    nodes: dict[int, None] = {}
    incoming: dict[tuple[int, int], float] = {}
    outgoing: dict[tuple[int, int], float] = {}
    for (u, v), label in g.edges.items():
        for x, y in by_label.get(label, ()):
            tail, head = u * width + x, v * width + y
            nodes[tail] = nodes[head] = None
            incoming[head, tail] = weight(v, y, label, "in")
            outgoing[tail, head] = weight(u, x, label, "out")
    edges = incoming | outgoing
    return list(nodes), [(a, b, w) for (a, b), w in edges.items()]


def iterate(initial: np.ndarray, nodes: list[int], edges: list[tuple[int, int, float]], formula: str, rounds: int, residual: float) -> np.ndarray:
    """The fixpoint of one propagation graph, each step scaled to a largest value of 1."""
    at = np.array(nodes, dtype=np.int64)
    src, dst = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
    w = np.array([e[2] for e in edges])
    now = initial.copy()
    for _ in range(rounds):
        new = np.zeros_like(initial)
        keep = {"basic": now, "a": initial, "b": np.zeros_like(now), "c": initial + now}[formula]
        new[at] = keep[at]
        flow = now if formula in ("basic", "a") else initial + now
        np.add.at(new, dst, w * flow[src])
        top = new.max(initial=0.0)
        if top > 0:
            new /= top
        gap = math.sqrt(float(((now - new) ** 2).sum()))
        now = new
        if gap <= residual:
            break
    return now


def flood(source: tuple[str, list[tuple[str, str]]], target: tuple[str, list[tuple[str, str]]], policy: str, formula: str, matcher: str, idf: dict[str, float] | None, rounds: int, residual: float) -> list[tuple[str, str, float]]:
    """(source column, target column, score) of one table pair, zero scores included."""
    g, h = schema_graph(*source), schema_graph(*target)
    width = len(h.nodes)
    measure = levenshtein_similarity if matcher == "levenshtein" else (lambda a, b: prefix_suffix(a, b, idf if matcher == "prefix_suffix_tfidf" else None))
    start = np.zeros(len(g.nodes) * width)
    for i, (k, a) in enumerate(g.nodes):
        if k == "lit":
            for j, (m, b) in enumerate(h.nodes):
                if m == "lit":
                    start[i * width + j] = measure(a, b)
    nodes, edges = product_weights(g, h, policy)
    end = iterate(start, nodes, edges, formula, rounds, residual)
    there = set(nodes)
    return [(a, b, float(end[u * width + v])) for u, a in g.columns for v, b in h.columns if u * width + v in there]


def literal_idf(tables: list[tuple[str, list[tuple[str, str]]]]) -> dict[str, float]:
    """IDF of lower-case words over all literals of the tables' graphs."""
    docs = [{w.lower() for w in split_words(text)} for t in tables for kind, text in schema_graph(*t).nodes if kind == "lit"]
    df: dict[str, int] = {}
    for d in docs:
        for w in d:
            df[w] = df.get(w, 0) + 1
    return {w: math.log(len(docs) / n) for w, n in df.items()}


def schemas(p: Profile) -> list[tuple[str, list[tuple[str, str]]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for c in p.columns:
        out.setdefault(c.table, []).append((c.column, c.dtype))
    return list(out.items())


def table_pairs(p: Profile) -> DataFrame:
    """One row per table pair with both schemas as JSON, earlier table first."""
    all_ = schemas(p)
    rows = [(json.dumps(a), json.dumps(b)) for i, a in enumerate(all_) for b in all_[i + 1:]]
    spark = p.counts.sparkSession
    df = spark.createDataFrame(rows, "source string, target string")
    return df.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))


def similarity_flooding(p: Profile, policy: str = "inverse_average", formula: str = "c", matcher: str = "prefix_suffix", tfidf_corpus: list | None = None, rounds: int = 100, residual: float = 1e-4) -> DataFrame:
    """The matcher: every column pair that the product graph holds, zero scores included.

    ``tfidf_corpus``: more tables for IDF when exactly two tables are matched; with
    more of them the batch's own tables are the corpus.
    """
    if policy not in ("inverse_average", "inverse_product") or formula not in ("basic", "a", "b", "c") or matcher not in ("prefix_suffix", "prefix_suffix_tfidf", "levenshtein"):
        raise InvalidConfig("unknown policy, formula or matcher")
    if rounds < 1 or residual < 0:
        raise InvalidConfig("rounds must be positive and the residual not negative")
    mine = schemas(p)
    idf = literal_idf(mine + (list(tfidf_corpus or []) if len(mine) == 2 else [])) if matcher == "prefix_suffix_tfidf" else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["source"], b["target"]):
                s, t = json.loads(x), json.loads(y)
                out += [(s[0], c, t[0], d, v) for c, d, v in flood((s[0], [tuple(z) for z in s[1]]), (t[0], [tuple(z) for z in t[1]]), policy, formula, matcher, idf, rounds, residual)]
            yield pd.DataFrame(out, columns=["source_table", "source_column", "target_table", "target_column", "score"])

    return table_pairs(p).mapInPandas(run, "source_table string, source_column string, target_table string, target_column string, score double")


def product_edges(p: Profile, policy: str = "inverse_average") -> DataFrame:
    """The propagation graphs as a relation, by joins on labels: tables, from and to nodes, weight.

    The relational form of ``product_weights`` for graphs too large for one batch.
    """
    spark = p.counts.sparkSession
    rows = [(no, u, v, label, i) for no, t in enumerate(schemas(p)) for i, ((u, v), label) in enumerate(schema_graph(*t).edges.items())]
    e = spark.createDataFrame(rows, "g int, u int, v int, label string, i int")
    out_d = e.groupBy("g", "label", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    in_d = e.groupBy("g", "label", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    rich = (e.join(out_d.select("g", "label", F.col("node").alias("u"), F.col("d").alias("out_d")), ["g", "label", "u"])
             .join(in_d.select("g", "label", F.col("node").alias("v"), F.col("d").alias("in_d")), ["g", "label", "v"]))
    x = rich.select("label", *(F.col(c).alias(f"{c}_1") for c in ("g", "u", "v", "out_d", "in_d")))
    y = rich.select("label", *(F.col(c).alias(f"{c}_2") for c in ("g", "u", "v", "out_d", "in_d")))
    both = x.join(y, "label").where("g_1 < g_2")
    w = lambda d: (2.0 / (F.col(f"{d}_1") + F.col(f"{d}_2"))) if policy == "inverse_average" else 1.0 / (F.col(f"{d}_1") * F.col(f"{d}_2"))
    inc = both.select("g_1", "g_2", F.col("v_1").alias("from_1"), F.col("v_2").alias("from_2"), F.col("u_1").alias("to_1"), F.col("u_2").alias("to_2"), w("in_d").alias("w"), F.lit(0).alias("prio"))
    out = both.select("g_1", "g_2", F.col("u_1").alias("from_1"), F.col("u_2").alias("from_2"), F.col("v_1").alias("to_1"), F.col("v_2").alias("to_2"), w("out_d").alias("w"), F.lit(1).alias("prio"))
    keys = ["g_1", "g_2", "from_1", "from_2", "to_1", "to_2"]
    return inc.unionByName(out).groupBy(*keys).agg(F.max_by("w", "prio").alias("weight"))
