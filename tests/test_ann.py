import numpy as np
import pytest

from canopy.operators import ann, cell_index, knn
from canopy.operators.vectors import VectorIndex
from canopy.storage import stored


def frame(spark, x, base=0):
    return spark.createDataFrame([(base + i, [float(f) for f in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_all_cells_give_exact_neighbours(spark, metric, monkeypatch):
    monkeypatch.setattr(ann, "TASK_ROWS", 25)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 6)), np.tile(rng.normal(size=(1, 6)), (30, 1)), np.zeros((4, 6))])
    df = frame(spark, x)
    key = lambda d: sorted((r["i"], r["rank"], r["j"], round(r["d"], 9)) for r in d.collect())
    assert key(ann.approximate_knn(df, 4, metric, probes=10**6, cells=9)) == key(knn.exact_knn(df, 4, metric))
    q = frame(spark, rng.normal(size=(12, 6)), 1000)
    assert key(ann.approximate_knn(df, 4, metric, q, probes=10**6, cells=9)) == key(knn.exact_knn(df, 4, metric, q))


def test_recall_of_some_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 2
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.7
    df = frame(spark, x)
    q = df.where("id % 20 = 0")
    true = knn.exact_knn(df, 10, "euclidean", q)
    found = ann.approximate_knn(df, 10, "euclidean", q, cells=40, probes=10)
    assert knn.recall(true, found, 10).first()["recall"] >= 0.9


@pytest.mark.parametrize("mode", ["approximate", "cells"])
def test_queries_are_not_copied_for_each_cell(spark, monkeypatch, mode):
    written = []

    def counted(df):
        out = stored(df)
        written.append(out.count())
        return out

    df = frame(spark, np.random.default_rng(4).normal(size=(400, 8)))
    index = VectorIndex("euclidean", mode=mode, probes=30).build_from_vectors(df)
    for module in (ann, cell_index):
        monkeypatch.setattr(module, "stored", counted)
    rows = []
    blocks = ann.in_blocks

    def met(*args):
        rows.append(stored(blocks(*args)))
        return rows[-1]

    for module in (ann, cell_index):
        monkeypatch.setattr(module, "in_blocks", met)
    assert index.query_batch(df, 3).count() == 1200
    assert max(written) == 400
    # One list for each query and block of cells, not for each cell
    assert rows[0].count() <= 400 * 8 * (4 if mode == "approximate" else 30)


def test_blocks_give_the_nearest_of_the_cells_looked_at():
    rng = np.random.default_rng(6)
    x, y, cell = rng.integers(0, 3, (40, 2)).astype(float), rng.integers(0, 3, (300, 2)).astype(float), np.sort(rng.integers(0, 21, 300))
    looked = rng.random((40, 21)) < 0.3
    row, j, d = ann.nearest_in_cells(x, np.packbits(looked, axis=1), np.arange(300), cell, y, 5, "euclidean")
    for r in range(40):
        far = np.linalg.norm(y - x[r], axis=1)
        own = sorted((far[i], i) for i in np.flatnonzero(looked[r, cell]))[:5]
        assert sorted(zip(d[row == r].tolist(), j[row == r].tolist(), strict=True)) == own


def test_modes_of_an_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(60, 5)))
    a = VectorIndex("cosine", mode="approximate", probes=100).build_from_vectors(df)
    b = VectorIndex("cosine").build_from_vectors(df)
    assert sorted(map(tuple, a.query_knn(3).select("i", "rank", "j").collect())) == sorted(map(tuple, b.query_knn(3).select("i", "rank", "j").collect()))
    a.save(str(tmp_path / "i"))
    assert VectorIndex.load(spark, str(tmp_path / "i")).mode == "approximate"
    with pytest.raises(ValueError):
        VectorIndex("jaccard", mode="approximate")
    with pytest.raises(ValueError):
        ann.approximate_knn(df, 60)


@pytest.mark.parametrize("mode", ["cells", "graph"])
def test_stored_modes_add_save_and_load(spark, tmp_path, mode):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    index = VectorIndex("euclidean", mode=mode, probes=100).build_from_vectors(frame(spark, x[:50]))
    keys = {r["id"]: r["key"] for r in index.add(frame(spark, x[50:])).collect()}
    assert keys == {i: 50 + i for i in range(10)} and index.n == 60
    index.save(str(tmp_path / "i"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    assert again.mode == mode and again.n == 60
    q = frame(spark, x)
    exact = knn.exact_knn(frame(spark, x), 3, "euclidean", q)
    assert knn.recall(exact, again.query_batch(q, 3), 3).first()["recall"] >= 0.9
    assert again.query_knn(2).where("i = j").count() == 0
