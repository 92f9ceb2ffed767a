import collections
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from canopy.operators import analysis, graph, knn, tree

EDGES = "u long, v long, w double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def random_forest(rng, sizes, reach=None):
    """Edges of random trees of these sizes; ``reach`` bounds how far back a node hangs, so that small values make trees deep."""
    edges, at = [], 0
    for n in sizes:
        ids = rng.sample(range(at, at + 3 * n), n)
        at += 3 * n
        for k in range(1, n):
            a, b = ids[k], ids[rng.randrange(max(0, k - reach) if reach else 0, k)]
            edges.append((min(a, b), max(a, b), rng.randrange(1, 64) / 8))
    return edges


def walk(edges, root):
    """Parents, depths, distances and depth-first places by plain recursion from a root."""
    near = collections.defaultdict(list)
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    out, stack = {}, [(root, None, 0, 0.0)]
    while stack:
        node, parent, depth, dist = stack.pop()
        out[node] = {"parent": parent, "depth": depth, "dist": dist, "dfs": len(out)}
        stack += [(o, node, depth + 1, dist + w) for o, w in sorted(near[node], reverse=True) if o != parent]
    for node in sorted(out, key=lambda n: -out[n]["dfs"]):
        out[node]["size"] = 1 + sum(out[o]["size"] for o, _ in near[node] if o != out[node]["parent"])
    for k, node in enumerate(sorted(out, key=lambda n: (out[n]["depth"], out[n]["dfs"]))):
        out[node]["bfs"] = k
    return out


@pytest.fixture(scope="module")
def ladder(spark):
    """A path of seven rungs with a side branch: 10-11-...-16 and 13-20-21."""
    edges = [(10 + i, 11 + i, 0.25 * (i + 1)) for i in range(6)] + [(13, 20, 2.0), (20, 21, 0.5)]
    return spark.createDataFrame(edges, EDGES)


def test_neighbour_graphs_give_forests(spark):
    rng = random.Random(21)
    for groups in (1, 3):
        rows = []
        for g in range(groups):
            for i in range(8):
                near = [(i + 1) % 8, *rng.sample([j for j in range(8) if j not in (i, (i + 1) % 8)], 2)]
                rows.append((8 * g + i, [8 * g + j for j in near] + [-1], [rng.randrange(1, 50) / 50 for _ in near] + [9.0]))
        made = knn.graph_from_arrays(spark.createDataFrame(rows, "i long, indices array<long>, distances array<double>"))
        assert made.where("j < 0").isEmpty() and graph.spanning_forest(graph.edges_from_graph(made)).count() == 7 * groups


def test_edges_that_count(spark):
    raw = spark.createDataFrame([(4, 2, 0.5), (2, 4, 0.25), (3, 3, 0.1), (0, 9, 0.2), (1, 2, -0.125), (1, 3, float("nan")), (0, 1, 0.0)], EDGES)
    assert rows(graph.clean_edges(raw, 5), "u", "v", "w") == [(0, 1, 0.0), (2, 4, 0.25)]
    square = spark.createDataFrame([(0, 1, 4.0), (1, 2, 1.0), (2, 3, 2.0), (0, 3, 3.0), (0, 2, 5.0)], EDGES)
    assert rows(graph.spanning_forest(square), "u", "v") == [(0, 3), (1, 2), (2, 3)]


def test_boruvka_agrees_with_kruskal(spark):
    rng = random.Random(3)
    edges = {(a, b): round(rng.random(), 2) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(120)) if a < b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], EDGES)
    assert rows(graph.boruvka(df), "u", "v") == rows(graph.spanning_forest(df), "u", "v")


def test_one_task_holds_few_edges_as_numbers_of_python():
    rng = np.random.default_rng(3)
    u, step = rng.integers(0, 50_000, 200_000), rng.integers(1, 50_000, 200_000)
    edges = pd.DataFrame({"u": np.minimum(u, (u + step) % 50_000), "v": np.maximum(u, (u + step) % 50_000), "w": rng.integers(0, 99, 200_000) / 7})
    # All at once they took 41 and 34 MB
    for of, most in ((graph._kruskal, 28), (graph._roots, 20)):
        tracemalloc.start()
        try:
            out = of(edges)
            assert tracemalloc.get_traced_memory()[1] < most * 1e6
        finally:
            tracemalloc.stop()
    assert len(out) == len(np.union1d(edges["u"], edges["v"])) and len(graph._kruskal(edges)) == len(out) - out["root"].nunique()


def test_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 5, 1.0), (3, 4, 1.0)], EDGES)
    for one_task in (100, 0):
        assert rows(graph.components(e, one_task=one_task), "node", "root") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1)]


@pytest.mark.parametrize("one_task", [tree.ONE_TASK_EDGES, -1])
@pytest.mark.parametrize(("sizes", "reach"), [((30,), None), ((40, 1, 12, 2), 3), ((300,), 1)])
def test_rooting_against_a_walk(spark, one_task, sizes, reach):
    rng = random.Random(sum(sizes))
    edges = random_forest(rng, sizes, reach)
    alone = 10_000
    nodes = sorted({x for u, v, _ in edges for x in (u, v)}) + [alone]
    root = max(n for n in nodes if n != alone)
    got = {r["node"]: r for r in tree.rooted(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(n,) for n in nodes], "node long"), root=root, one_task=one_task).collect()}
    assert sorted(got) == nodes
    left, want = set(nodes), {}
    for start in [root, *nodes]:
        if start in left:
            found = walk(edges, start)
            want |= {n: {**w, "root": start} for n, w in found.items()}
            left -= found.keys()
    for n, w in want.items():
        # Breadth-first order goes by parents' order, as depth-first order within a level does
        assert {k: got[n][k] for k in w} == pytest.approx(w), n


def test_a_chain_takes_few_rounds(spark):
    n = 20_000
    chain = spark.range(n - 1).selectExpr("id AS u", "id + 1 AS v", "0.5D AS w")
    got = tree.rooted(chain, root=0, one_task=-1)
    assert got.where("depth <> node OR dfs <> node OR bfs <> node OR size <> 20000 - node OR dist <> 0.5 * node").isEmpty() and got.count() == n


def test_paths_distances_and_balls(ladder):
    t = tree.rooted(ladder, root=12)
    assert [r["node"] for r in tree.path(t, 21, 15).collect()] == [21, 20, 13, 14, 15]
    assert tree.distance(t, 21, 15) == pytest.approx(0.5 + 2.0 + 1.0 + 1.25)
    assert tree.distance(t, 14, 14) == 0
    assert sorted(r["node"] for r in tree.subtree(ladder, 13, 1).collect()) == [12, 13, 14, 20]


def test_unconnected_nodes(spark):
    f = spark.createDataFrame([(5, 6, 0.5), (6, 8, 1.5), (20, 22, 1.0)], EDGES)
    t = tree.rooted(f)
    with pytest.raises(IndexError):
        tree.path(t, 5, 22)
    with pytest.raises(ValueError):
        tree.path(t, 5, 7)
    assert tree.distance(t, 8, 20) == math.inf
    assert dict(rows(tree.distances_from(f, 6), "node", "dist")) == {5: 0.5, 6: 0, 8: 1.5, 20: math.inf, 22: math.inf}


def test_closure_by_doubling_agrees(ladder, monkeypatch):
    t = tree.rooted(ladder, root=11)
    walked = rows(tree.closure(t), "node", "ancestor", "steps")
    monkeypatch.setattr(tree, "ONE_TASK_PAIRS", -1)
    assert rows(tree.closure(t), "node", "ancestor", "steps") == walked


def test_analysis_against_counting(spark):
    rng = random.Random(8)
    edges = random_forest(rng, (40, 15), 4)
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    label = {n: rng.choice("pqr") for n in nodes}
    df, labels = spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(label.items()), "id long, label string")
    ends = collections.defaultdict(list)
    for u, v, w in edges:
        ends[u].append(w)
        ends[v].append(w)
    asked = spark.createDataFrame([(n,) for n in [*nodes, 999]], "id long")
    assert dict(rows(analysis.diversity(df, asked), "node", "diversity")) == pytest.approx({n: sum(ends[n]) / max(1, len(ends[n])) for n in [*nodes, 999]})
    counted = collections.Counter((a, b) for u, v, _ in edges for a, b in ((label[u], label[v]), (label[v], label[u])))
    assert rows(analysis.confusion(df, labels), "label_a", "label_b", "n") == sorted((*k, n) for k, n in counted.items())
    assert rows(analysis.boundary_edges(df, labels), "u", "v") == sorted((u, v) for u, v, _ in edges if label[u] != label[v])
    t = tree.rooted(df, root=nodes[3])
    below = collections.defaultdict(collections.Counter)
    for r in tree.closure(t).collect():
        below[r["ancestor"]][label[r["node"]]] += 1
    got = {r["node"]: r["purity"] for r in analysis.purity(t, labels, min_size=4).collect()}
    assert got == {n: max(c.values()) / sum(c.values()) if sum(c.values()) >= 4 else None for n, c in below.items()}


def test_failure_paths_on_a_ladder(ladder, spark):
    p = spark.createDataFrame([(10, 1, 1), (12, 1, 2), (16, 2, 2), (21, 2, 1), (15, 2, 2)], "id long, label int, predicted int")
    v = spark.createDataFrame([(n, float((7 * n) % 11)) for n in (*range(10, 17), 20, 21)], "id long, value double")
    got = {r["node"]: (r["to"], r["hops"], r["least"]) for r in analysis.failure_paths(tree.rooted(ladder, root=11), p, v).collect()}
    value = lambda *path: min(float((7 * n) % 11) for n in path)
    assert got == {12: (10, 2, value(10, 11, 12)), 21: (15, 4, value(21, 20, 13, 14, 15))}


def test_clean_edges_of_all_nodes(spark, tmp_path):
    from canopy.plans import registry

    rng = np.random.default_rng(4)
    x = {i: rng.normal(size=8) for i in range(380, 430)}
    rows = [(i, [float(f) for f in v], 0) for i, v in x.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    want = set()
    for i in x:
        near = sorted((1 - unit[i] @ unit[j], j) for j in x if j != i)[: registry.K]
        want |= {(min(i, j), max(i, j)) for d, j in near if d >= 0.6}
    got = {(r["u"], r["v"]) for r in registry.QUERIES["clean_edges"](spark, str(tmp_path)).collect()}
    assert got == want and any(v >= 400 for _, v in want)


def test_failure_paths_join_no_ancestors(spark, monkeypatch):
    n = 400
    edges = [(i - 1 - i % 3 if i > 3 else 0, i, 1.0) for i in range(1, n)]
    label = [i % 2 for i in range(n)]
    p = [(i, label[i], label[i] if i % 37 < 2 else 1 - label[i]) for i in range(n)]
    rooted = tree.rooted(spark.createDataFrame(edges, "u long, v long, w double"), root=0)

    def never(*args):
        raise AssertionError("rows of all ancestors grow with nodes times depth")

    monkeypatch.setattr(analysis, "closure", never, raising=False)
    v = [float((i * 7919) % 1009) for i in range(n)]
    got = {r["node"]: (r["to"], r["hops"], r["least"]) for r in analysis.failure_paths(rooted, spark.createDataFrame(p, "id long, label long, predicted long"), spark.createDataFrame(list(enumerate(v)), "id long, x double")).collect()}
    beside = {i: [] for i in range(n)}
    for a, b, _ in edges:
        beside[a].append(b)
        beside[b].append(a)
    goals = {k: [i for i, a, b in p if a == b == k][:20] for k in (0, 1)}
    want = []
    for i, a, b in p:
        if a != b:
            before, queue = {i: None}, [(i, 0)]
            hops = {i: 0}
            for node, h in queue:
                for m in beside[node]:
                    if m not in before:
                        before[m], hops[m] = node, h + 1
                        queue.append((m, h + 1))
            h, to = min((hops[g], g) for g in goals[a])
            way, at = [], to
            while at is not None:
                way.append(at)
                at = before[at]
            want.append((-h, i, to, min(v[q] for q in way)))
    assert got == {i: (to, -h, low) for h, i, to, low in sorted(want)[:5]}
