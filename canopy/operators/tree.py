"""Rooted forests: traversal, paths, distances, subtrees.

A rooted forest is ``(node, root, parent, depth, dist, bfs, dfs, size)``: bfs and dfs number each tree's nodes from 0, neighbours in order of id; size counts the node and what is below it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.graph import both_ways, components
from canopy.storage import stored

ROOTED = "node long, root long, parent long, depth int, dist double, bfs long, dfs long, size long"
#: Edges up to which one task roots a forest, at about 1 KB each; beyond, links are doubled.
ONE_TASK_EDGES = 500_000
#: (node, ancestor) pairs up to which each tree is walked in one task, at 20 bytes each.
ONE_TASK_PAIRS = 5_000_000
#: Nodes asked for that are sent to all executors.
FEW = 100_000


def _root(edges: pd.DataFrame, nodes: list[int], first: list[int]) -> pd.DataFrame:
    near: dict[int, list[tuple[int, float]]] = {n: [] for n in nodes}
    for u, v, w in zip(edges["u"].tolist(), edges["v"].tolist(), edges["w"].tolist(), strict=True):
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    for list_of in near.values():
        list_of.sort()
    seen: dict[int, tuple[int, int | None, int, float]] = {}
    rows = []
    for root in [*[r for r in first if r in near], *sorted(near)]:
        if root in seen:
            continue
        seen[root] = (root, None, 0, 0.0)
        queue = [root]
        for node in queue:
            _, _, depth, dist = seen[node]
            for other, w in near[node]:
                if other not in seen:
                    seen[other] = (root, node, depth + 1, dist + w)
                    queue.append(other)
        size = dict.fromkeys(queue, 1)
        for node in reversed(queue[1:]):
            size[seen[node][1]] += size[node]
        dfs, stack = {}, [root]
        while stack:
            node = stack.pop()
            dfs[node] = len(dfs)
            stack += [o for o, _ in reversed(near[node]) if seen[o][1] == node and o not in dfs]
        rows += [(node, *seen[node], bfs, dfs[node], size[node]) for bfs, node in enumerate(queue)]
    out = pd.DataFrame(rows, columns=["node", "root", "parent", "depth", "dist", "bfs", "dfs", "size"])
    out["parent"] = out["parent"].astype("Int64")
    return out


def rooted(forest: DataFrame, nodes: DataFrame | None = None, root: int | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Root every tree of the forest: at ``root`` if it is there, else at its least node. ``nodes (node)`` adds isolated ones."""
    edges = forest.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    first = [] if root is None else [root]
    if edges.count() > one_task:
        return _rooted_by_doubling(edges, nodes, root)
    members = edges.select(F.col("u").alias("node")) if nodes is None else nodes.select(F.col(nodes.columns[0]).cast("long").alias("node"))
    left = edges.groupBy(F.lit("all").alias("k"))
    right = members.distinct().groupBy(F.lit("all").alias("k"))
    return left.cogroup(right).applyInPandas(lambda e, n: _root(e, n["node"].tolist(), first), ROOTED)


def doubled(rows: DataFrame, keys: list[str], to: list[str], compose: dict[str, Callable[[Column, Column], Column]], rounds: int = 64) -> DataFrame:
    """Sums along pointers: ``rows`` have ``keys``, a pointer ``to`` (null at an end) to other rows' keys, and values. Each round doubles the way that a row has gone, so that as many rounds are needed as bits in the longest.

    compose: for each value, of a row's own and of that at the place where its way ends.
    """
    rows = stored(rows)
    for _ in range(rounds):
        if rows.where(F.col(to[0]).isNotNull()).isEmpty():
            return rows
        far = rows.select(*[F.col(k).alias(t) for k, t in zip(keys, to, strict=True)], *[F.col(t).alias(f"_{t}") for t in to], *[F.col(v).alias(f"_{v}") for v in compose])
        # Rows that have arrived take no part in the join
        gone, going = rows.where(F.col(to[0]).isNull()), rows.where(F.col(to[0]).isNotNull())
        met = going.join(far, to).select(*keys, *[F.col(f"_{t}").alias(t) for t in to], *[f(F.struct(*compose), F.struct(*[F.col(f"_{v}").alias(v) for v in compose])).alias(v) for v, f in compose.items()])
        rows = stored(met.unionByName(gone))
    raise RuntimeError(f"pointers did not end in {rounds} rounds")


def _rooted_by_doubling(edges: DataFrame, nodes: DataFrame | None, root: int | None) -> DataFrame:
    """Parents and sizes from ranks in Euler tours, all else from sums along parents; both by doubling, so that the number of jobs grows with the logarithm of the depth.

    A tour leaves a node by the neighbour after the one that it came from, in order of id and round about; it ends where it would leave the root by its least neighbour again.
    """
    near = stored(both_ways(edges))
    label = components(edges)
    if root is not None:
        moved = label.where(F.col("node") == root).select(F.col("root").alias("r"))
        label = label.join(F.broadcast(moved), label["root"] == moved["r"], "left").select("node", F.when(F.col("r").isNotNull(), F.lit(root)).otherwise(F.col("root")).alias("root"))
    if nodes is not None:
        every = nodes.select(F.col(nodes.columns[0]).cast("long").alias("node")).distinct()
        label = every.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    label = stored(label)
    after = F.lead("b").over(Window.partitionBy("a").orderBy("b"))
    least = near.groupBy("a").agg(F.min("b").alias("low"))
    turn = near.select("a", "b", after.alias("c")).join(least, "a").join(label.where("node = root").select(F.col("node").alias("a"), F.lit(True).alias("top")), "a", "left")
    # From b to a, and on to c
    tour = turn.select(F.col("b").alias("u"), F.col("a").alias("v"), F.coalesce("c", F.when(F.col("top").isNull(), F.col("low"))).alias("c"))
    links = tour.select("u", "v", F.when(F.col("c").isNotNull(), F.col("v")).alias("nu"), F.col("c").alias("nv"), F.lit(1).cast("long").alias("n"))
    ranks = doubled(links, ["u", "v"], ["nu", "nv"], {"n": lambda x, y: x["n"] + y["n"]})
    back = ranks.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("m"))
    down = ranks.join(back, ["u", "v"]).where("n > m").select(F.col("v").alias("node"), F.col("u").alias("parent"), ((F.col("n") - F.col("m") + 1) / 2).cast("long").alias("size"))
    down = down.join(near.select(F.col("a").alias("parent"), F.col("b").alias("node"), "w"), ["parent", "node"])
    before = F.sum("size").over(Window.partitionBy("parent").orderBy("node")) - F.col("size")
    steps = down.select("node", F.col("parent").alias("up"), F.lit(1).alias("depth"), F.col("w").alias("dist"), (1 + before).cast("long").alias("dfs"))
    tops = label.where("node = root").select("node", F.lit(None).cast("long").alias("up"), F.lit(0).alias("depth"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("dfs"))
    add = {v: (lambda x, y, v=v: x[v] + y[v]) for v in ("depth", "dist", "dfs")}
    sums = doubled(steps.unionByName(tops), ["node"], ["up"], add).drop("up")
    whole = label.groupBy("root").agg(F.count(F.lit(1)).alias("all"))
    both = stored(label.join(whole, "root").join(sums, "node").join(down.select("node", "parent", "size"), "node", "left").withColumn("size", F.coalesce("size", "all")).drop("all"))
    per_level = both.withColumn("k", F.row_number().over(Window.partitionBy("root", "depth").orderBy("dfs")) - 1)
    counts = both.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("s", F.sum("n").over(Window.partitionBy("root").orderBy("depth")) - F.col("n")).drop("n")
    return per_level.join(starts, ["root", "depth"]).select("node", "root", "parent", "depth", "dist", (F.col("s") + F.col("k")).cast("long").alias("bfs"), "dfs", "size")


def neighbours(forest: DataFrame, node: int) -> DataFrame:
    """G8."""
    return both_ways(forest).where(F.col("a") == node).select(F.col("b").alias("node"), "w")


def children(forest: DataFrame, node: int, parent: int | None) -> DataFrame:
    """Neighbours but the parent."""
    found = neighbours(forest, node)
    return found if parent is None else found.where(F.col("node") != parent)


def _ancestors(tree: pd.DataFrame) -> pd.DataFrame:
    tree = tree.sort_values("dfs")
    nodes, depths = tree["node"].to_numpy(), tree["depth"].to_numpy()
    above = np.zeros(int(depths.max()) + 1, np.int64)
    parts = []
    for node, depth in zip(nodes.tolist(), depths.tolist(), strict=True):
        above[depth] = node  # in depth-first order, what stands at lower depths are ancestors
        parts.append(above[: depth + 1][::-1].copy())
    size = depths + 1
    ends = np.cumsum(size)
    return pd.DataFrame({"node": np.repeat(nodes, size), "ancestor": np.concatenate(parts), "steps": (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int32)})


def closure(rooted_forest: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(node, ancestor, steps)``, the node itself at 0. ``of (node)``: for these only.

    A task walks each tree if all depths add up to few rows; otherwise links are doubled, as many joins as bits in the depth.
    """
    depth, rows = rooted_forest.agg(F.max("depth"), F.sum("depth")).first()
    depth = depth or 0
    if (rows or 0) <= ONE_TASK_PAIRS:
        pairs = rooted_forest.groupBy("root").applyInPandas(_ancestors, "node long, ancestor long, steps int")
        if of is None:
            return pairs
        asked = stored(of.select("node").distinct())
        return pairs.join(F.broadcast(asked) if asked.count() <= FEW else asked, "node")
    up = stored(rooted_forest.select("node", "parent", "depth"))
    jump = up.where("parent IS NOT NULL").select("node", F.col("parent").alias("to"))
    start = up.select("node") if of is None else of.select("node").distinct()
    cover = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    length = 1
    while length <= depth:
        far = cover.join(jump.withColumnRenamed("node", "ancestor"), "ancestor").select("node", F.col("to").alias("ancestor"), (F.col("steps") + length).alias("steps"))
        cover = stored(cover.unionByName(far))
        length *= 2
        if length <= depth:
            jump = stored(jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.to").alias("to")))
    return cover


def _checked(rooted_forest: DataFrame, *nodes: int) -> dict[int, int]:
    have = {r["node"]: r["root"] for r in rooted_forest.where(F.col("node").isin(*nodes)).select("node", "root").collect()}
    for n in nodes:
        if n not in have:
            raise ValueError(f"there is no node {n}")
    return have


def path(rooted_forest: DataFrame, a: int, b: int) -> DataFrame:
    """``(pos, node)`` from a to b. Unknown nodes raise ValueError, unconnected ones IndexError."""
    have = _checked(rooted_forest, a, b)
    if have[a] != have[b]:
        raise IndexError(f"no path joins {a} and {b}")
    spark = rooted_forest.sparkSession
    up = closure(rooted_forest, spark.createDataFrame([(a,), (b,)], "node long")).join(rooted_forest.select(F.col("node").alias("ancestor"), "depth"), "ancestor")
    shared = up.where(F.col("node") == a).select("ancestor", "depth").join(up.where(F.col("node") == b).select("ancestor"), "ancestor", "left_semi")
    low = shared.orderBy(F.desc("depth")).limit(1).select(F.col("depth").alias("low")).first()["low"]
    da = rooted_forest.where(F.col("node") == a).first()["depth"]
    rising = up.where((F.col("node") == a) & (F.col("depth") >= low)).select((F.lit(da) - F.col("depth")).cast("int").alias("pos"), F.col("ancestor").alias("node"))
    falling = up.where((F.col("node") == b) & (F.col("depth") > low)).select((F.lit(da - 2 * low) + F.col("depth")).cast("int").alias("pos"), F.col("ancestor").alias("node"))
    return rising.unionByName(falling).orderBy("pos")


def distance(rooted_forest: DataFrame, a: int, b: int) -> float:
    """Sum of weights on the path, inf if there is none."""
    have = _checked(rooted_forest, a, b)
    if have[a] != have[b]:
        return float("inf")
    spark = rooted_forest.sparkSession
    up = closure(rooted_forest, spark.createDataFrame([(a,), (b,)], "node long").distinct())
    shared = up.groupBy("ancestor").agg(F.count_distinct("node").alias("n")).where(F.col("n") == len({a, b}))
    deepest = shared.join(rooted_forest.select(F.col("node").alias("ancestor"), "depth", "dist"), "ancestor").orderBy(F.desc("depth")).first()["dist"]
    ends = {r["node"]: r["dist"] for r in rooted_forest.where(F.col("node").isin(a, b)).collect()}
    return ends[a] + ends[b] - 2 * deepest


def distances_from(forest: DataFrame, source: int, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, dist)`` to every node, inf where there is no path."""
    at = rooted(forest, nodes, root=source)
    return at.select("node", F.when(F.col("root") == source, F.col("dist")).otherwise(float("inf")).alias("dist"))


def subtree(forest: DataFrame, node: int, depth: int | None = None) -> DataFrame:
    """The ball of ``depth`` edges around a node, on all sides: ``(node, depth)``, nearest first."""
    ball = rooted(forest, root=node).where(F.col("root") == node)
    return (ball if depth is None else ball.where(F.col("depth") <= depth)).orderBy("bfs").select("node", "depth")
