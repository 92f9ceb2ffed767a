"""Edges, components and minimum spanning forests. Edges are ``(u, v, w)`` with u < v."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.storage import stored

EDGES = "u long, v long, w double"
#: Edges up to which one task runs Kruskal's algorithm; beyond, Boruvka's rounds run as joins.
ONE_TASK_EDGES = 2_000_000
#: Edges that such a task holds as Python's own numbers at once.
CHUNK = 1 << 16


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def edges_from_graph(graph: DataFrame) -> DataFrame:
    """F1, G1: undirected edges of a kNN graph ``(i, j, d)``, each with its least distance; no loops, empty slots or infinite distances."""
    d = F.col("d").cast("double")
    good = graph.where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") != F.col("j")) & finite(d))
    return good.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.min(d).alias("w"))


def clean_edges(edges: DataFrame, n: int | None = None) -> DataFrame:
    """weights below 0 and ids outside 0 .. n - 1 go, loops too, and of parallel edges the heavier."""
    good = edges.where((F.col("w") >= 0) & finite(F.col("w")) & (F.col("u") != F.col("v")))
    if n is not None:
        good = good.where(F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1))
    return good.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Adjacency ``(a, b, w)``."""
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "w"))


def _numbered(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in order, and the places of each edge's ends among them."""
    u, v = edges["u"].to_numpy(), edges["v"].to_numpy()
    ids = np.union1d(u, v)
    return ids, np.stack([np.searchsorted(ids, c).astype(np.int32) for c in (u, v)], axis=1)


def _pairs(ends: np.ndarray) -> Iterator[list[int]]:
    for at in range(0, len(ends), CHUNK):
        yield from ends[at : at + CHUNK].tolist()


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.iloc[np.lexsort((edges["v"], edges["u"], edges["w"]))]
    ids, ends = _numbered(edges)
    parent = list(range(len(ids)))
    keep = np.zeros(len(edges), bool)
    for k, (a, b) in enumerate(_pairs(ends)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep[k] = True
    return edges[keep]


def spanning_forest(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """The minimum spanning forest; order (w, u, v) is total, so there is one."""
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    if edges.count() <= one_task:
        return edges.groupBy(F.lit("all").alias("k")).applyInPandas(_kruskal, EDGES)
    return boruvka(edges)


def boruvka(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Each round, every tree takes its least edge to another tree; trees so joined become one."""
    edges = stored(edges)
    live = stored(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")))
    chosen = None
    for _ in range(rounds):
        edge = F.struct("w", "u", "v")
        ways = live.select(F.col("cu").alias("c"), F.col("cv").alias("o"), edge.alias("e")).unionByName(live.select(F.col("cv").alias("c"), F.col("cu").alias("o"), edge.alias("e")))
        least = ways.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m"))
        took = stored(least.select("c", F.col("m.o").alias("o"), F.col("m.e.u").alias("u"), F.col("m.e.v").alias("v"), F.col("m.e.w").alias("w")))
        if took.isEmpty():
            return edges.limit(0) if chosen is None else stored(chosen.distinct())
        new = took.select("u", "v", "w").distinct()
        chosen = new if chosen is None else chosen.unionByName(new)
        label = components(took.select(F.col("c").alias("u"), F.col("o").alias("v")))
        a, b = (label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("cu", "cv"))
        live = stored(live.join(a, "cu", "left").join(b, "cv", "left").select("u", "v", "w", F.coalesce("rcu", "cu").alias("cu"), F.coalesce("rcv", "cv").alias("cv")).where("cu <> cv"))
    raise RuntimeError(f"trees were not joined in {rounds} rounds")


def _roots(edges: pd.DataFrame) -> pd.DataFrame:
    ids, ends = _numbered(edges)
    parent = list(range(len(ids)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in _pairs(ends):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": ids, "root": ids[[find(a) for a in range(len(ids))]] if len(ids) else ids})


def components(edges: DataFrame, rounds: int = 64, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, root)`` of all nodes with edges; the root is the component's least node.

    One task joins sets up to ``one_task`` edges; beyond, large and small stars take turns until nothing changes.
    """
    edges = stored(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    if edges.count() <= one_task:
        return edges.groupBy(F.lit("all").alias("k")).applyInPandas(_roots, "node long, root long")
    links = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct())
    before = None
    for _ in range(rounds):
        ways = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(ways.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        links = stored(small.unionByName(low.select("x", F.col("m").alias("y"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def degrees(edges: DataFrame) -> DataFrame:
    """A2: ``(node, degree)``."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def degree_root(edges: DataFrame) -> DataFrame:
    """The node of greatest degree, the least id among several; node 0 if there are no edges."""
    best = degrees(edges).orderBy(F.desc("degree"), "node").limit(1)
    none = edges.sparkSession.sql("SELECT 0L AS node, 0L AS degree")
    return best.unionByName(none).orderBy(F.desc("degree"), "node").limit(1)


def tree_weights(tree: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Tree edges with the weights of the graph they come from, 1.0 where it has none."""
    t = tree.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return t.join(graph_edges.select("u", "v", "w"), ["u", "v"], "left").select("u", "v", F.coalesce("w", F.lit(1.0)).alias("w"))


def component_count(n_nodes: int, forest: DataFrame) -> int:
    """Q10."""
    return n_nodes - forest.count()
