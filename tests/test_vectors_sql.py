import numpy as np
import pytest

from canopy.functions.encode import minhash
from canopy.functions.sql import register
from canopy.operators.vectors import VectorIndex


def test_added_points_are_found(spark):
    rows = [(i, [10.0] * 4) for i in range(20)]
    index = VectorIndex().build_from_vectors(spark.createDataFrame(rows, "id long, v array<double>"))
    keys = index.add(spark.createDataFrame([(7, [0.0] * 4)], "id long, v array<double>"))
    assert keys.first()["key"] == 20 and index.n == 21
    assert index.query_point([0.01] * 4, 1).first()["j"] == 20
    assert index.query_knn(3).where("i = j").count() == 0
    with pytest.raises(ValueError):
        index.query_batch(spark.createDataFrame([(0, [1.0])], "id long, v array<double>"), 1)
    with pytest.raises(ValueError):
        index.query_knn(21)


def test_binary_rows(spark, tmp_path):
    rng = np.random.default_rng(42)
    x = (rng.random((30, 64)) < 0.4).astype(int)
    index = VectorIndex("jaccard").build_from_binary(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<int>"))
    index.save(str(tmp_path / "i"))
    index = VectorIndex.load(spark, str(tmp_path / "i"))
    for r in index.query_knn(4).collect():
        a, b = x[r["i"]], x[r["j"]]
        assert r["d"] == pytest.approx(1 - (a & b).sum() / (a | b).sum())
    assert index.query_point(x[3].tolist(), 1).first()["j"] == 3
    with pytest.raises(Exception, match="0 and 1"):
        VectorIndex("jaccard").build_from_binary(spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 0, 1])], "id long, v array<int>"))
    with pytest.raises(RuntimeError):
        VectorIndex().query_knn(2)


def test_sql_functions(spark):
    register(spark, 64, 1)
    sets = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4]), (2, []), (3, None)], "id long, on array<bigint>")
    sets.createOrReplaceTempView("sets_of_sql")
    got = {r["id"]: r["s"] for r in spark.sql("SELECT id, minhash(`on`) AS s FROM sets_of_sql").collect()}
    want = {r["id"]: r["sig"] for r in minhash(sets, 64, 1).collect()}
    assert {k: list(v) for k, v in got.items()} == want
    assert spark.sql("SELECT signature_distance(array(1L, 2L), array(1L, 3L)) AS d, obs_to_numeric('day_2') AS n, obs_to_numeric('x') AS u").first() == (0.5, 2.0, None)


def test_stream_of_points(spark, tmp_path):
    from canopy.plans.model import TreeMap
    from canopy.streaming.transform import add_stream, transform_stream

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(20)]
    old, new = spark.createDataFrame(rows[:15], "id long, v array<double>"), spark.createDataFrame(rows[15:], "id long, v array<double>")
    model = TreeMap(3, "euclidean").fit(old)
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    transform_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    placed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "x", "y").collect())
    assert placed == sorted(tuple(r) for r in model.transform(new).collect())
    add_stream(stream, model, str(tmp_path / "c2")).awaitTermination()
    assert model.embedding_.count() == 20


def test_nearest_as_a_table_function(spark):
    register(spark, 64, 1)
    rng = np.random.default_rng(4)
    rows = [(int(i), int(j), None if rng.random() < 0.1 else float(rng.integers(0, 5)), f"n{n}") for n, (i, j) in enumerate(rng.integers(0, 9, (300, 2)))]
    spark.createDataFrame(rows, "i long, j long, d double, note string").createOrReplaceTempView("pairs_of_sql")
    got = {}
    for r in spark.sql("SELECT * FROM nearest(TABLE(pairs_of_sql), 4)").collect():
        got.setdefault(r["i"], []).append((r["rank"], r["d"], r["j"]))
    want = {i: [(n + 1, *x) for n, x in enumerate(sorted((d, j) for a, j, d, _ in rows if a == i and d is not None)[:4])] for i in {r[0] for r in rows}}
    assert {i: sorted(v) for i, v in got.items()} == want
    assert spark.sql("SELECT * FROM nearest(TABLE(SELECT * FROM pairs_of_sql WHERE i < 0), 4)").count() == 0
    assert spark.sql("SELECT * FROM nearest(TABLE(pairs_of_sql), 0)").count() == 0
    with pytest.raises(Exception, match="there is no d, j"):
        spark.sql("SELECT * FROM nearest(TABLE(SELECT i FROM pairs_of_sql), 4)").collect()
    with pytest.raises(Exception, match="rank"):
        spark.sql("SELECT * FROM nearest(TABLE(SELECT *, 1 AS rank FROM pairs_of_sql), 4)").collect()


def test_bands_and_paths_in_sql(spark):
    from canopy.functions.encode import bands
    from canopy.functions.sql import register_tree
    from canopy.operators import tree

    register(spark, 64, 1)
    sigs = spark.createDataFrame([(n, [n * k for k in range(11)]) for n in range(5)], "id long, sig array<bigint>")
    sigs.createOrReplaceTempView("signatures_of_sql")
    got = spark.sql("SELECT s.id, b.band, b.h FROM signatures_of_sql s, LATERAL bands(s.sig, 3) b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bands(sigs, 3).collect()))

    rng = np.random.default_rng(9)
    edges = [(int(rng.integers(max(0, n - 4), n)), n, 1.0) for n in range(1, 40)] + [(41, 40, 1.0)]
    near = {n: set() for n in range(43)}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    nodes = spark.range(43).withColumnRenamed("id", "node")
    register_tree(spark, tree.rooted(spark.createDataFrame(edges, "u long, v long, w double"), nodes, 0), "way_of_sql")

    def walk(a, b):
        stack = [[a]]
        while stack:
            p = stack.pop()
            if p[-1] == b:
                return p
            stack += [[*p, o] for o in near[p[-1]] if o not in p]
        return []

    for a, b in [(0, 39), (39, 0), (17, 38), (5, 5), (40, 41), (42, 42), (3, 40), (3, 99)]:
        got = [r["node"] for r in spark.sql(f"SELECT * FROM way_of_sql({a}, {b}) ORDER BY pos").collect()]
        assert got == (walk(a, b) if b in near else []), (a, b)
    with pytest.raises(ValueError, match="name"):
        register_tree(spark, nodes, "x; y")
