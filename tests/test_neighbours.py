import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from canopy.functions import encode
from canopy.operators import knn
from canopy.operators.lsh import SignatureIndex
from canopy.schema import InputKind, check, kind_of


def clustered(n=60, d=32):
    rng = np.random.default_rng(42)
    c = rng.normal(size=(3, d))
    return c[np.arange(n) % 3] + 0.1 * rng.normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_exact_neighbours(spark, metric, limit, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 25)
    x = clustered()
    got = {}
    for r in knn.exact_knn(frame(spark, x), 5, metric, broadcast_bytes=limit).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["d"]))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        d = 1 - y @ y[i] if metric == "cosine" else np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:5]
        have = sorted(got[i])
        assert [h[1] for h in have] == want.tolist()
        assert np.allclose([h[2] for h in have], d[want])


def test_repeated_vectors_are_never_their_own_neighbours(spark):
    x = np.repeat(np.random.default_rng(1).normal(size=(10, 8)), 2, axis=0)
    assert knn.exact_knn(frame(spark, x), 3, "cosine").where("i = j").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_many_equal_vectors_are_ordered_by_id(spark, metric, limit, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[100:] = x[100]
    got = {}
    for r in knn.exact_knn(frame(spark, x), 5, metric, broadcast_bytes=limit).where("i >= 100").collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    for i in range(100, 400):
        assert [j for _, j in sorted(got[i])] == [j for j in range(100, 107) if j != i][:5]


def test_zero_vectors_are_far_from_all(spark):
    got = knn.exact_knn(frame(spark, np.array([[0.0, 0], [1, 0], [0, 1]])), 2, "cosine").where("i = 0").collect()
    assert [r["d"] for r in got] == [1.0, 1.0]


def test_matrix(spark):
    p = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    m = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(4) for j in range(4)], "i long, j long, d double")
    assert [(r["j"], r["d"]) for r in knn.knn_from_matrix(m, 2).where("i = 0").orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    with pytest.raises(ValueError):
        knn.knn_from_matrix(m, 4)


def test_minhash_estimates_jaccard(spark):
    s = spark.createDataFrame([(0, list(range(1, 9))), (1, list(range(5, 13))), (2, [])], "id long, on array<long>")
    sig = {r["id"]: r["sig"] for r in encode.minhash(s, 512, 1).collect()}
    same = np.mean(np.array(sig[0]) == np.array(sig[1]))
    assert abs(same - 4 / 12) < 0.1
    assert set(sig[2]) == {encode.MASK}
    t = spark.createDataFrame([(0, ["apple", "banana", "cherry", "date", "elderberry"]), (1, ["cherry", "date", "elderberry", "fig", "grape"])], "id long, tokens array<string>")
    sig = {r["id"]: r["sig"] for r in encode.minhash(t, 512, 1).collect()}
    assert abs(np.mean(np.array(sig[0]) == np.array(sig[1])) - 3 / 7) < 0.1


def test_negative_members_fail(spark):
    with pytest.raises(Exception, match="negative"):
        encode.minhash(spark.createDataFrame([(0, [-1])], "id long, on array<long>"), 8, 1).collect()


def test_weighted_minhash(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [9.0, 1.0, 1.0, 1.0, 1.0])], "id long, v array<double>")
    sig = {r["id"]: [tuple(x) for x in r["sig"]] for r in encode.weighted_minhash(v, 5, 256, 1).collect()}
    assert sig[0] == sig[1]
    want = (1 + 1 + 1 + 1 + 1) / (9 + 2 + 3 + 4 + 5)
    assert abs(np.mean([a == b for a, b in zip(sig[0], sig[2])]) - want) < 0.1


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 31, 128)
    sigs = []
    for _ in range(10):
        s = base.copy()
        s[rng.choice(128, 64, False)] = rng.integers(0, 1 << 31, 64)
        sigs.append(s)
    sigs += [rng.integers(0, 1 << 31, 128) for _ in range(10)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sigs)], "id long, sig array<long>")
    return SignatureIndex(128).add(df).build(), np.array(sigs)


def test_lsh_graph(index):
    idx, sigs = index
    got = idx.knn_graph(3, 50).collect()
    assert got and all(r["i"] != r["j"] and r["d"] < 0.8 for r in got)
    for r in got:
        assert r["d"] == pytest.approx(1 - np.mean(sigs[r["i"]] == sigs[r["j"]]))
    assert idx.size == 20 and idx.is_clean and idx.is_indexed


def test_lsh_queries_and_files(index, spark, tmp_path):
    idx, sigs = index
    assert idx.query_by_id(0, 3).where("j = 0").count() == 0
    assert idx.query(idx.signature(2), 1).first()["j"] == 2
    assert idx.distance_by_id(0, 1) == pytest.approx(1 - np.mean(sigs[0] == sigs[1]))
    assert idx.all_distances(sigs[4].tolist()).where("d = 0").first()["j"] == 4
    sub = spark.createDataFrame([(5,), (6,)], "id long")
    assert [r["j"] for r in idx.linear_scan(idx.signature(5), sub, 2).orderBy("rank").collect()] == [5, 6]
    idx.save(str(tmp_path / "x"))
    back = SignatureIndex.load(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, back.knn_graph(3).select("i", "j").collect())) == sorted(map(tuple, idx.knn_graph(3).select("i", "j").collect()))
    with pytest.raises(RuntimeError):
        SignatureIndex(128, store=False).add(idx.sigs).build().knn_graph(2)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_lsh_search_finds_exact_neighbours(spark, limit, monkeypatch):
    from canopy.operators import lsh

    monkeypatch.setattr(lsh, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    # Sets of low similarity, as texts have, a third of them one set, an empty one and a null one
    sets = [sorted({int(x) for x in rng.zipf(1.5, 60) if x < 4000}) for _ in range(200)] + [list(range(5000, 5020))] * 100 + [[], None]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, on array<long>")
    idx = SignatureIndex(32, 32).add(encode.minhash(df, 32, 7)).build()
    asked = df.where("id % 20 = 0 OR id >= 300")
    got = {}
    for r in idx.search(asked, df, 5).collect():
        got.setdefault(r["i"], []).append((r["d"], r["j"]))
    hits = total = 0
    for i in [*range(0, 300, 20)]:
        a = set(sets[i])
        exact = {j: 1 - len(a & set(s)) / len(a | set(s)) for j, s in enumerate(sets) if s and a & set(s)}
        best = sorted((d, j) for j, d in exact.items())[:5]
        assert got[i] == sorted(got[i]) and all(d == pytest.approx(exact[j]) for d, j in got[i])
        hits += len({j for _, j in got[i]} & {j for _, j in best})
        total += len(best)
    assert hits >= 0.9 * total and not {300, 301} & set(got)
    assert [j for _, j in got[220]] == [200, 201, 202, 203, 204]


def test_kinds_and_checks(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id long, v array<double>")
    assert kind_of(d) is InputKind.DENSE
    with pytest.raises(ValueError):
        check(d, InputKind.DENSE)
    with pytest.raises(ValueError):
        check(spark.createDataFrame([(0, [float("nan")])], "id long, v array<double>"), InputKind.DENSE)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_jaccard_neighbours(spark, limit, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(2)
    sets = [set(rng.integers(0, 25, 6).tolist()) for _ in range(20)] + [set()]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, on array<long>")
    got = sorted(tuple(r) for r in knn.jaccard_knn(df, 3).collect())
    want = []
    for i, a in enumerate(sets):
        near = sorted((1 - len(a & b) / len(a | b), j) for j, b in enumerate(sets) if i != j and a & b)[:3]
        want += [(i, k, j, pytest.approx(d)) for k, (d, j) in enumerate(near, 1)]
    assert got == want


@pytest.mark.parametrize("limit", [knn.BROADCAST_BYTES, 0])
def test_rows_of_bits_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(knn, "BIT_ROWS", 32)
    monkeypatch.setattr(knn, "BIT_QUERIES", 7)
    rng = np.random.default_rng(5)
    sets = [sorted(np.flatnonzero(rng.random(60) < 0.2).tolist()) for _ in range(150)] + [[3, 4, 5]] * 40 + [[]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, on array<long>")

    def near(q, own=None):
        each = sorted((1.0 - len(set(q) & set(s)) / len(set(q) | set(s)), j) for j, s in enumerate(sets) if j != own and set(q) & set(s))
        return [(r + 1, j, round(d, 9)) for r, (d, j) in enumerate(each[:6])]

    def got(g):
        out = {}
        for r in sorted(g.collect(), key=lambda r: (r["i"], r["rank"])):
            out.setdefault(r["i"], []).append((r["rank"], r["j"], round(r["d"], 9)))
        return out

    assert got(knn.jaccard_knn(df, 6)) == {i: near(s, i) for i, s in enumerate(sets) if s}
    asked = {1000: [1, 2, 3, 900, 901], 1001: [70000], 1002: sets[5]}
    q = spark.createDataFrame(list(asked.items()), "id long, on array<long>")
    assert got(knn.jaccard_knn(df, 6, q)) == {i: near(s) for i, s in asked.items() if near(s)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_memory_of_exact_neighbours_does_not_grow_with_the_points(metric, monkeypatch):
    """F12 to F31."""
    x = np.random.default_rng(4).normal(size=(60_000, 4))
    tracemalloc.start()
    knn.nearest(np.arange(300), x[:300], np.arange(len(x)), x, 3, metric, True)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # distances of all at once are 144 MB
    tracemalloc.stop()
    x[1000:3000] = x[7]  # copies in several tiles
    monkeypatch.setattr(knn, "POINTS", 700)
    monkeypatch.setattr(knn, "QUERIES", 40)
    i, rank, j, _ = knn.nearest(np.arange(90), x[:90], np.arange(5000), x[:5000], 6, metric, True)
    y = x[:5000] / np.linalg.norm(x[:5000], axis=1, keepdims=True)
    for q in range(90):
        d = 1 - (y * y[q]).sum(axis=1) if metric == "cosine" else np.linalg.norm(x[:5000] - x[q], axis=1)
        d[q] = np.inf
        assert j[i == q][np.argsort(rank[i == q])].tolist() == np.lexsort((np.arange(5000), d.round(12)))[:6].tolist()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_that_meet_are_held_once(metric, monkeypatch):
    monkeypatch.setattr(knn, "POINTS", 512)
    monkeypatch.setattr(knn, "QUERIES", 64)
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(40_000, 64)), rng.permutation(40_000)
    v = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))
    p = pa.Table.from_batches(pa.table({"pid": ids, "pv": v}).to_batches(10_000))
    q = pa.Table.from_batches(pa.table({"id": ids, "v": v}).slice(0, 600).to_batches(250))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        got = knn.nearest_of_blocks(q, p, 5, metric, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # One copy of the points (20 MB) and flat values of two batches; with copies by pandas it was 47 MB
    assert peak < 1.6 * x.nbytes
    assert pa.total_allocated_bytes() - arrow < 4 << 20
    by = np.argsort(ids)
    want = knn.nearest(ids[:600], x[:600], ids[by], x[by], 5, metric, True)
    assert all((got[c].to_numpy() == w).all() for c, w in zip(("i", "rank", "j", "d"), want, strict=True))
    assert knn.nearest_of_blocks(q.slice(0, 0), p, 5, metric, True).num_rows == knn.nearest_of_blocks(q, p.slice(0, 0), 5, metric, True).num_rows == 0


def test_a_matrix_is_neither_sorted_nor_written(spark, monkeypatch):
    """F2."""
    monkeypatch.setattr(knn, "MATRIX_ROWS", 300)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (60, 60)).astype(float)  # many ties
    matrix = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(60)], "i long, j long, d double")
    calls = []
    once = knn.ranked
    monkeypatch.setattr(knn, "ranked", lambda pairs, k: calls.append(pairs.count()) or once(pairs, k))
    got = {(r["i"], r["rank"]): r["j"] for r in knn.knn_from_matrix(matrix.coalesce(2), 4).collect()}
    assert got == {(i, r + 1): j for i in range(60) for r, (_, j) in enumerate(sorted((x[i, j], j) for j in range(60) if j != i)[:4])}
    assert calls[0] <= 2 * 60 * 4
    for wrong in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            knn.knn_from_matrix(spark.createDataFrame([(0, 1, 1.0), (1, 0, wrong)], "i long, j long, d double"), 1)
    with pytest.raises(ValueError):
        knn.knn_from_matrix(matrix, 60)
