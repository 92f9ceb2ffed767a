"""Functions for SQL users."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from canopy.functions.encode import permutations, signatures_of


class Nearest:
    """``nearest(TABLE(t), k)`` numbers the rows ``(i, j, d)`` of each ``i`` from 1, by ``d`` and then ``j``, and passes over those after the ``k``-th.

    The call needs no PARTITION BY or ORDER BY: the function states both, so that Spark brings an ``i`` together in order and no task holds its rows. Types and further columns are those of the table. Rows without ``d`` are left out, and so is everything where ``k`` is below 1.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("nearest(TABLE(t), k) takes a table first")
        names = [f.name for f in rows.dataType.fields]
        if missing := {"i", "j", "d"} - set(names):
            raise ValueError(f"nearest needs columns i, j, d; there is no {', '.join(sorted(missing))}")
        if "rank" in names:
            raise ValueError("nearest adds a column rank, which the table has")
        if k.isTable or k.isConstantExpression is False:
            raise ValueError("k is one number for all rows")
        schema = T.StructType([*rows.dataType.fields, T.StructField("rank", T.IntegerType(), False)])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("i")], orderBy=[OrderingColumn("d", ascending=True, overrideNullsFirst=False), OrderingColumn("j")])

    def __init__(self) -> None:
        self.rank = 0

    def eval(self, rows, k):
        # nulls come last
        if self.rank >= k or rows["d"] is None:
            raise SkipRestOfInputTableException("the nearest are known")
        self.rank += 1
        yield (*rows, self.rank)


def register(spark: SparkSession, num_perm: int = 128, seed: int = 1) -> None:
    """``minhash(array<bigint>)`` and the table function ``nearest``; as SQL, ``signature_distance(a, b)``, ``obs_to_numeric(text)`` and the table function ``bands(signature, count)`` of rows ``(band, h)``, the same as ``encode.bands``."""
    a, b = permutations(num_perm, seed)

    @F.pandas_udf("array<bigint>")
    def minhash(sets: pd.Series) -> pd.Series:
        size = np.array([0 if s is None else len(s) for s in sets])
        flat = np.concatenate([np.asarray(s, np.int64) for s in sets if s is not None and len(s)]) if size.sum() else np.zeros(0, np.int64)
        return pd.Series(list(signatures_of(flat, np.concatenate(([0], np.cumsum(size))), a, b).astype(np.int64)))

    spark.udf.register("minhash", minhash)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION signature_distance(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE "
        "RETURN 1 - size(filter(zip_with(a, b, (x, y) -> x = y), e -> e)) / size(a)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION obs_to_numeric(t STRING) RETURNS DOUBLE RETURN try_cast(regexp_replace(t, '[^0-9.-]', '') AS DOUBLE)")
    spark.udtf.register("nearest", F.udtf(Nearest))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION bands(sig ARRAY<BIGINT>, count INT) RETURNS TABLE(band INT, h BIGINT) "
        "RETURN SELECT posexplode(transform(sequence(0, bands.count - 1), n -> xxhash64(slice(bands.sig, n * (size(bands.sig) div bands.count)::INT + 1, (size(bands.sig) div bands.count)::INT))))"
    )


def register_tree(spark: SparkSession, rooted: DataFrame, name: str = "tree_path") -> None:
    """G12 in SQL: the table function ``name(a, b)`` gives ``(pos, node)``, the nodes on the way in a rooted forest, and the view ``<name>_nodes`` the forest.

    A node is above another if its depth-first range holds the other's number, so that filters on a tree's nodes beside the two ends find what stands above either, however deep; the way is what isn't above their meeting. No rows where nothing joins them, or a node is unknown. For many pairs take ``pairs.PathIndex``, since a call reads the tree.
    """
    if not name.isidentifier():
        raise ValueError(f"{name} is no name of a function")
    rooted.select("node", "root", "depth", "dfs", "size").createOrReplaceTempView(f"{name}_nodes")

    above = {e: f"({e}.dfs >= t.dfs AND {e}.dfs < t.dfs + t.size)" for e in ("a", "b")}
    ends = f"{name}_nodes a JOIN {name}_nodes b ON a.root = b.root JOIN {name}_nodes t ON t.root = a.root WHERE a.node = {name}.a AND b.node = {name}.b AND ({above['a']} %s {above['b']})"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a BIGINT, b BIGINT) RETURNS TABLE(pos INT, node BIGINT) RETURN "
        "SELECT CAST(CASE WHEN of_a THEN depth_a - w.depth ELSE depth_a + w.depth - 2 * m.depth END AS INT) AS pos, w.node FROM "
        f"(SELECT t.node, t.depth, a.depth AS depth_a, {above['a']} AS of_a FROM {ends % 'OR'}) w JOIN "
        f"(SELECT max(t.depth) AS depth FROM {ends % 'AND'}) m ON w.depth >= m.depth"
    )
