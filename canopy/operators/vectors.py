"""An index of dense vectors or binary rows: build, add, ask, save, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.scalars import in_order
from canopy.operators.ann import approximate_knn
from canopy.operators.cell_index import CellIndex
from canopy.operators.graph_index import GraphIndex
from canopy.operators.knn import exact_knn, jaccard_knn
from canopy.schema import InputKind, binary_sets, check
from canopy.storage import stored

#: Modes whose index is stored.
INDEXED = ("cells", "graph")
META = "metric string, mode string, probes int, n long, width int"


class VectorIndex:
    """Neighbours by cosine or Euclidean distance, or by Jaccard distance of set bits.

    mode: ``exact``, or for dense vectors one that may miss some: ``approximate``, which makes cells for each question (see ``ann``), or ``cells`` and ``graph``, which are fitted once, stored, and grow by the rows added (see ``cell_index`` and ``graph_index``). ``probes``: cells that a query looks at. What they find is measured in registered queries.
    """

    def __init__(self, metric: str = "euclidean", mode: str = "exact", probes: int | None = None) -> None:
        if metric not in ("cosine", "euclidean", "jaccard"):
            raise ValueError("metric is cosine, euclidean or jaccard")
        if mode not in ("exact", *INDEXED, "approximate") or (mode != "exact" and metric == "jaccard"):
            raise ValueError("mode is exact, or approximate, cells or graph for dense vectors")
        self.metric, self.mode, self.probes = metric, mode, probes
        self.rows: DataFrame | None = None
        self.inner: CellIndex | GraphIndex | None = None
        self.n = self.width = 0

    def _fitted(self) -> CellIndex | GraphIndex:
        return CellIndex(self.metric, self.probes) if self.mode == "cells" else GraphIndex(self.metric)

    def _built(self) -> DataFrame:
        if self.rows is None:
            raise RuntimeError("the index is empty; build it first")
        return self.rows

    def build_from_vectors(self, vectors: DataFrame) -> VectorIndex:
        """``(id, v)``, two rows at least."""
        if self.metric == "jaccard":
            raise ValueError("jaccard takes binary rows")
        self.n = check(vectors, InputKind.DENSE)
        if self.n < 2:
            raise ValueError("an index needs two rows at least")
        self.rows = stored(vectors.select(F.col(vectors.columns[0]).cast("long").alias("id"), F.col(vectors.columns[1]).cast("array<double>").alias("v")))
        self.width = self.rows.select(F.size("v")).first()[0]
        if self.mode in INDEXED:
            self.inner = self._fitted().build(self.rows)
        return self

    def build_from_binary(self, rows: DataFrame) -> VectorIndex:
        """``(id, v)`` of zeros and ones; only set bits are kept."""
        if self.metric != "jaccard":
            raise ValueError(f"{self.metric} takes dense vectors")
        self.rows = stored(binary_sets(rows, rows.columns[0], rows.columns[1]))
        self.n, self.width = self.rows.count(), rows.select(F.size(rows.columns[1])).first()[0]
        return self

    def add(self, vectors: DataFrame) -> DataFrame:
        """Rows under new keys, in order of their own ids: ``(id, key)``. They can be found at once."""
        rows = self._built()
        name = vectors.columns[0]
        low = rows.agg(F.max("id")).first()[0]
        keys = stored(in_order(vectors.select(F.col(name).alias("id")), ["id"], "key").withColumn("key", F.col("key") + 1 + low))
        if self.metric == "jaccard":
            made = binary_sets(vectors, name, vectors.columns[1])
        else:
            check(vectors, InputKind.DENSE, self.width)
            made = vectors.select(F.col(name).alias("id"), F.col(vectors.columns[1]).cast("array<double>").alias("v"))
        new = made.join(keys, "id").drop("id").withColumnRenamed("key", "id").select(*rows.columns)
        new = stored(new)
        if self.inner is not None:
            self.inner.add(new)
        self.rows = rows.unionByName(new)
        self.n += new.count()
        return keys

    def query_knn(self, k: int) -> DataFrame:
        """The graph of all rows; no row is its own neighbour."""
        rows = self._built()
        if not 1 <= k < self.n:
            raise ValueError(f"k must be at least 1 and less than the {self.n} rows")
        if self.metric == "jaccard":
            return jaccard_knn(rows, k)
        if self.inner is not None:
            return self.inner.neighbours(k)
        return exact_knn(rows, k, self.metric) if self.mode == "exact" else approximate_knn(rows, k, self.metric, probes=self.probes)

    def query_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """The nearest of each query; rows equal to it count."""
        rows, k = self._built(), min(k, self.n)
        if self.metric == "jaccard":
            return jaccard_knn(rows, k, binary_sets(queries, *queries.columns[:2]))
        check(queries, InputKind.DENSE, self.width)
        if self.inner is not None:
            return self.inner.search(queries, k)
        return exact_knn(rows, k, self.metric, queries) if self.mode == "exact" else approximate_knn(rows, k, self.metric, queries, self.probes)

    def query_point(self, vector: list[float], k: int) -> DataFrame:
        """``(rank, j, d)``."""
        kind = "array<int>" if self.metric == "jaccard" else "array<double>"
        values = [int(x) for x in vector] if self.metric == "jaccard" else [float(x) for x in vector]
        one = self._built().sparkSession.createDataFrame([(0, values)], f"id long, v {kind}")
        return self.query_batch(one, k).select("rank", "j", "d")

    def save(self, path: str) -> None:
        """K3."""
        rows = self._built()
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        if self.inner is not None:
            self.inner.save(f"{path}/index")
        rows.sparkSession.createDataFrame([(self.metric, self.mode, self.probes, self.n, self.width)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """S13."""
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        out = cls(meta["metric"], meta["mode"], meta["probes"])
        out.n, out.width, out.rows = meta["n"], meta["width"], spark.read.parquet(f"{path}/rows")
        if out.mode in INDEXED:
            out.inner = type(out._fitted()).load(spark, f"{path}/index")
        return out
