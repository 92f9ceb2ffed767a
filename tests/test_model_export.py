import json
import math

import numpy as np
import pytest

from canopy.export import binary
from canopy.export.viz import TreeMapViz, category_order, css_rgba, file_name, hex_colour
from canopy.operators import facets
from canopy.operators.layout import LayoutConfig, layout_from_edges
from canopy.plans.model import NotFitted, TreeMap


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(42)
    c = rng.normal(size=(3, 8))
    x = c[np.arange(30) % 3] + 0.1 * rng.normal(size=(30, 8))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def model(vectors):
    return TreeMap(5, "euclidean").fit(vectors)


def test_fit(model):
    e = model.embedding_.toPandas()
    assert len(e) == 30 and e[["x", "y"]].abs().to_numpy().max() <= 0.5 + 1e-9
    assert model.tree_.count() <= 29 and model.graph_.count() == 150


def test_same_data_same_places(model, vectors):
    again = TreeMap(5, "euclidean").fit(vectors.repartition(3))
    a, b = (m.embedding_.toPandas().sort_values("id").to_numpy() for m in (model, again))
    assert np.allclose(a, b)


def test_new_points(vectors, spark):
    m = TreeMap(5, "euclidean").fit(vectors)
    new = vectors.limit(3).selectExpr("id + 100 AS id", "v")
    before = m.embedding_.toPandas().sort_values("id")
    placed = m.transform(new)
    assert placed.count() == 3 and m.embedding_.count() == 30
    m.add_points(new)
    after = m.embedding_.toPandas().sort_values("id")
    assert len(after) == 33 and np.allclose(after.head(30)[["x", "y"]], before[["x", "y"]])
    assert m.kneighbors(vectors.where("id = 0").selectExpr("id + 500 AS id", "v")).where("d = 0").count() == 2
    with pytest.raises(ValueError):
        m.add_points(new)


def test_save_and_load(model, vectors, spark, tmp_path):
    model.save(str(tmp_path / "m"))
    back = TreeMap.load(spark, str(tmp_path / "m"))
    new = vectors.selectExpr("id + 50 AS id", "v")
    assert sorted(map(tuple, back.transform(new).collect())) == sorted(map(tuple, model.transform(new).collect()))


def test_sets_and_lsh(spark):
    rng = np.random.default_rng(1)
    rows = [(i, sorted({*range(100 * (i % 3), 100 * (i % 3) + 20), *rng.integers(0, 300, 3).tolist()})) for i in range(24)]
    sets = spark.createDataFrame(rows, "id long, on array<long>")
    exact, hashed = TreeMap(4).fit(sets), TreeMap(4, n_permutations=128, search="index").fit(sets)
    for m in (exact, hashed):
        assert m.graph_.where("i % 3 <> j % 3").count() == 0
    with pytest.raises(NotFitted):
        _ = exact.index_
    hashed.add_points(sets.selectExpr("id + 100 AS id", "on").limit(2))
    assert hashed.index_.size == 26


def test_options(vectors, spark):
    for bad in ({"metric": "manhattan"}, {"n_neighbors": 0}):
        with pytest.raises(ValueError):
            TreeMap(**bad)
    with pytest.raises(ValueError):
        TreeMap().fit()
    with pytest.raises(TypeError):
        TreeMap(metric="jaccard").fit(vectors)
    with pytest.raises(NotFitted):
        _ = TreeMap().tree_


def test_layout_edges(spark):
    one = spark.createDataFrame([(0,)], "id long")
    none = spark.createDataFrame([], "u long, v long, w double")
    assert [tuple(r) for r in layout_from_edges(one, none)[0].collect()] == [(0, 0.0, 0.0)]
    assert layout_from_edges(one.limit(0), none)[0].count() == 0
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(3)], "u long, v long, w double")
    xy = layout_from_edges(spark.range(4), chain, create_mst=False)[0].toPandas()[["x", "y"]].to_numpy()
    assert np.abs(xy).max() == pytest.approx(0.5)
    with pytest.raises(ValueError):
        LayoutConfig(placer="Nowhere")


def test_bytes():
    x = np.linspace(-1, 1, 11)
    for bits in (16, 32):
        assert np.allclose(binary.dequantize(binary.quantize(x, bits), bits), x, atol=3 / (1 << bits))
    with pytest.raises(ValueError):
        binary.quantize(x, 8)
    got = binary.Container.read(binary.payload(x, x, {"n": [1] * 11, "c": ["b", "a"] + ["b"] * 9}, {"t": 1}))
    assert [s[:2] for s in got.sections] == [("coords", "coords"), ("number", "n"), ("category", "c")]
    assert np.frombuffer(got.sections[2][2], "<u4").tolist() == [0, 1] + [0] * 9
    assert got.metadata == {"t": 1, "dictionaries": {"c": ["b", "a"]}}
    with pytest.raises(ValueError):
        binary.Container.read(b"something else")


def test_large_components_are_swept_like_small_ones():
    import pandas as pd

    from canopy.operators.layout import place_tree

    for n in (1499, 1501, 20_000):
        rng = np.random.default_rng(n)
        parent = [None] + [int(rng.integers(max(0, i - 40), i)) for i in range(1, n)]
        size, depth = [1] * n, [0] * n
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        below = [[] for _ in range(n)]
        for i in range(1, n):
            below[parent[i]].append(i)
        dfs, stack = [0] * n, [0]
        for k in range(n):
            dfs[at := stack.pop()] = k
            stack += reversed(below[at])
        tree = pd.DataFrame({"node": range(n), "root": 0, "parent": pd.array(parent, "Int64"), "depth": depth, "dfs": dfs, "size": size})

        def apart(sweeps, tree=tree):
            """Places that differ by a quarter of an edge."""
            return len(np.unique(np.floor(place_tree(tree, sweeps)[["x", "y"]].to_numpy() * 4), axis=0)) / n

        assert apart(40) > apart(0)


def test_names_and_colours():
    seen: set = set()
    assert [file_name(n, seen) for n in ("a b", "a/b", "..")] == ["a_b", "a_b_2", "column"]
    assert hex_colour("#ABC") == "#aabbcc" and css_rgba("#000", 0.4) == "rgba(0, 0, 0, 0.4)"
    with pytest.raises(ValueError):
        hex_colour("red")
    assert category_order(["10", "9", "1"]) == ["1", "9", "10"] and category_order(["b", "a"]) == ["b", "a"]


def test_pages(model, spark, tmp_path):
    number = spark.createDataFrame([(i, float(i) if i else None) for i in range(30)], "id long, n double")
    label = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "id long, c string")
    viz = model.to_viz("A map").add_color_layout("n", number).add_color_layout("c", label, categorical=True).add_label("l", label)
    assert viz.layouts == ["n", "c"] and viz.labels == ["n", "c", "l"]
    with pytest.raises(ValueError):
        viz.add_label("n", label)
    with pytest.raises(ValueError):
        viz.add_color_layout("bad", label)
    viz.add_smiles(label)
    with pytest.raises(ValueError):
        viz.add_smiles(label)
    page = viz.write_html(str(tmp_path / "page"))
    assert page.endswith(".html") and "A map" in open(page).read()
    folder = viz.write_static(str(tmp_path / "s"))
    meta = json.load(open(f"{folder}/metadata.json"))
    assert meta["points"]["n"] == 30 and meta["filters"] == ["n", "c"]
    assert "<svg" in viz.to_svg("c") and "#888888" in viz.to_svg("n")
    with pytest.raises(ValueError):
        model.to_viz().add_label("l", label.limit(3)).to_dataframe()
    with pytest.raises(ValueError):
        TreeMapViz().set_points(spark.createDataFrame([(0, math.nan, 0.0)], "id long, x double, y double"))


def test_quotas():
    sizes = {"0": 6, "1": 3, "2": 1}
    assert facets.quotas(sizes, 6) == {"0": 4, "1": 1, "2": 1}
    assert facets.quotas(sizes, 6, "balanced") == {"0": 3, "1": 2, "2": 1}
    assert facets.quotas(sizes, 10) == sizes
    with pytest.raises(ValueError):
        facets.quotas({str(i): 5 for i in range(9)}, 4)
