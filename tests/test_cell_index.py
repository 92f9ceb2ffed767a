import numpy as np
import pytest

from canopy.operators import cell_index, knn
from canopy.operators.cell_index import CellIndex


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cells_are_fitted_once_and_grow_by_new_rows(spark, tmp_path, monkeypatch, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 20)) + rng.integers(0, 5, (900, 1)) * 2
    old, new = frame(spark, x[:800]), frame(spark, x[800:], 800)
    index = CellIndex(metric, seed=3).build(old)

    def refused(*_):
        raise AssertionError("fitted again")

    monkeypatch.setattr(cell_index, "centroids", refused)
    monkeypatch.setattr(cell_index, "TASK_ROWS", 20)  # cells and their queries take several tasks
    q = frame(spark, x[::20], 10_000)
    found = index.search(q, 5)
    assert knn.recall(knn.exact_knn(old, 5, metric, q), found, 5).first()["recall"] >= 0.9
    before = set(index.rows.inputFiles())
    index.add(new)
    assert before < set(index.rows.inputFiles())
    every = old.unionByName(new)
    true = knn.exact_knn(every, 5, metric, q)
    asked = index.search(q, 5)
    assert knn.recall(true, asked, 5).first()["recall"] >= 0.9
    index.save(str(tmp_path / "c"))
    again = CellIndex.load(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, again.search(q, 5).collect())) == sorted(map(tuple, asked.collect()))
    wide = CellIndex.load(spark, str(tmp_path / "c"))
    wide.probes = 10**6
    exact = {(r["i"], r["j"]): r["d"] for r in true.collect()}
    got = wide.search(q, 5).collect()
    assert all(abs(exact[r["i"], r["j"]] - r["d"]) < 1e-9 for r in got if (r["i"], r["j"]) in exact)
    assert again.search(q.limit(0), 5).count() == 0


def test_index_needs_vectors(spark):
    with pytest.raises(ValueError, match="needs a vector"):
        CellIndex().build(frame(spark, np.zeros((0, 3))))
    with pytest.raises(RuntimeError):
        CellIndex().search(frame(spark, np.zeros((1, 3))), 1)
    one = CellIndex().build(frame(spark, np.ones((1, 3))))
    assert [tuple(r) for r in one.search(frame(spark, np.ones((2, 3)), 5), 3).orderBy("i").collect()] == [(5, 1, 0, 0.0), (6, 1, 0, 0.0)]
