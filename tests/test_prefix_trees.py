"""Prefix trees over bands, deepened for each query."""

import numpy as np
import pytest

from canopy.functions.encode import minhash
from canopy.operators.lsh import SignatureIndex
from tests.test_prefix import clustered


@pytest.fixture(scope="module")
def held(spark):
    own = clustered(300)
    own |= {500 + i: own[7] for i in range(100)} | {700: set(), 701: {88888}}  # a hot text, an empty and a lone set
    table = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id long, s array<long>")
    return own, table, SignatureIndex(64, 16).add(minhash(table, 64, 1)).build()


def test_levels_against_a_loop(spark, held):
    own, table, index = held
    sigs = {r["id"]: list(r["sig"]) for r in index.sigs.collect()}
    asked = [i for i in sorted(own) if i % 20 == 0]
    queries = index.sigs.where("id % 20 = 0")
    for want in (1, 40, 10_000):
        expected = set()
        for i in asked:
            for depth in (4, 3, 2, 1):
                met = {j for j in sigs if any(sigs[i][t * 4 : t * 4 + depth] == sigs[j][t * 4 : t * 4 + depth] for t in range(16))}
                if len(met) >= want or depth == 1:
                    break
            expected |= {(i, j) for j in met}
        many = index.deepened(queries, index.sigs, lambda pairs: pairs, lambda rows, depth: rows.groupBy("i").count().where(f"count >= {want}"))  # noqa: B023
        got = [tuple(r) for r in many.collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_neighbours_of_copies_and_lone_sets(spark, held):
    own, table, index = held
    asked = [7, 20, 140, 500, 560, 700, 701, 999]
    got = index.nearest(spark.createDataFrame([(i,) for i in asked], "id long"), table, 5).toPandas()
    near = {i: list(zip(g["j"], g["d"], strict=True)) for i, g in got.sort_values("rank").groupby("i")}
    assert set(near) == {7, 20, 140, 500, 560, 701}
    for i in (7, 500, 560):  # copies: the least ids
        assert near[i] == [(7, 0.0)] + [(500 + n, 0.0) for n in range(4)]
    assert near[701] == [(701, 0.0)]
    for i in (20, 140):
        want = sorted((1 - len(own[i] & t) / len(own[i] | t), j) for j, t in own.items() if own[i] & t)[:5]
        assert [d for _, d in near[i]] == sorted(d for _, d in near[i])
        assert np.mean([j in dict(near[i]) for _, j in want]) >= 0.8


def test_recall_below_all_comparisons(spark, held):
    own, table, index = held
    asked = [i for i in own if i % 20 == 0 and own[i]]
    queries = table.where("id % 20 = 0").select("id")
    got = {(r["i"], r["j"]) for r in index.nearest(queries, table, 5).collect()}
    want = {(i, j) for i in asked for _, j in sorted((1 - len(own[i] & t) / len(own[i] | t), j) for j, t in own.items() if own[i] & t)[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert 0 < sum(index.compared) < len(asked) * len(own) / 2


def test_no_members(spark):
    none = spark.createDataFrame([], "id long, s array<long>")
    index = SignatureIndex(8, 4).add(minhash(none, 8, 1)).build()
    assert index.nearest(none.select("id"), none, 3).count() == 0
