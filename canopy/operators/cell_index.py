"""Dense vectors in stored cells with quantised residuals: fitted once, added to and asked without fitting again.

Centroids of cells, and of parts of what is left when a vector's centroid is taken away, are fitted on a bounded sample; every vector is in the index. A row holds its cell, one byte for each part and the vector itself, and rows of a cell stand together in files. A query looks at codes in its nearest cells only, by distances to the vectors that codes stand for. The nearest by codes are ranked again by their vectors. Blocks of queries meet blocks of cells, over which large cells are dealt (see ``ann``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.ann import LEAST_CELLS, MOST_CELLS, SAMPLE, SHARE, TASK_ROWS, centroids, closest, in_blocks, looking
from canopy.operators.graph_index import _distances
from canopy.operators.knn import _matrix, _unit, ranked
from canopy.storage import stored

#: Bytes of vectors on which cells and codes are fitted, and of centroids that go to every executor, at most.
SAMPLE_BYTES, CENTROID_BYTES = 128 << 20, 64 << 20
#: Bytes of a code, values of one, and how many times k are ranked again by their vectors.
CODE, WORDS, AGAIN = 16, 256, 10
ROW = "id long, v array<double>, cell int, code binary"


class CellIndex:
    """Neighbours by cosine or Euclidean distance; some may be missed. ``probes``: cells that a query looks at."""

    def __init__(self, metric: str = "euclidean", probes: int | None = None, seed: int = 42) -> None:
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"metric {metric} has no vectors")
        self.metric, self.probes, self.seed = metric, probes, seed
        self.cells: np.ndarray | None = None
        self.words: list[np.ndarray] = []
        self.rows: DataFrame | None = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(df.columns[0]).cast("long").alias("id"), F.col(df.columns[1]).cast("array<double>").alias("v"))

    def _seen(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) if self.metric == "cosine" else x

    def build(self, points: DataFrame) -> CellIndex:
        """From ``(id, v)``, unique ids and vectors of one length; one row at least."""
        rows = stored(self._vectors(points))
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        if not n:
            raise ValueError("an index of cells needs a vector to be fitted on")
        sample = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
        taken = rows.where(F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(-(-n // sample))) == 0).limit(sample)
        x = self._seen(_matrix(taken.select("v").toArrow()["v"]))
        x = x if len(x) else self._seen(_matrix(rows.limit(1).select("v").toArrow()["v"]))
        most = max(1, min(MOST_CELLS, CENTROID_BYTES // (8 * max(width, 1)), len(x) // 2))
        self.cells = centroids(x, min(most, max(LEAST_CELLS, round(4 * n**0.5))), self.seed)
        left = x - self.cells[closest(x, self.cells, 1)[:, 0]]
        self.words = [centroids(part, min(WORDS, len(x)), self.seed + i) for i, part in enumerate(np.array_split(left, min(CODE, width), axis=1))]
        self.rows = self._coded(rows)
        return self

    def _coded(self, rows: DataFrame) -> DataFrame:
        """Rows with cell and code, those of a cell together."""
        shared = rows.sparkSession.sparkContext.broadcast((self.cells, self.words, self.metric))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, words, metric = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("v"))
                x = _unit(x) if metric == "cosine" else x
                cell = closest(x, cells, 1)[:, 0]
                parts = np.array_split(x - cells[cell], len(words), axis=1)
                code = np.stack([closest(p, w, 1)[:, 0] for p, w in zip(parts, words, strict=True)], axis=1).astype(np.uint8)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "v", "cell", "code"])

        return stored(rows.mapInArrow(run, ROW).repartition("cell").sortWithinPartitions("cell", "id"))

    def _built(self) -> DataFrame:
        if self.rows is None:
            raise RuntimeError("the index is empty; build it first")
        return self.rows

    def add(self, points: DataFrame) -> CellIndex:
        """More vectors, under ids that the index doesn't have: their rows are written, and nothing else."""
        self.rows = self._built().unionByName(self._coded(self._vectors(points)))
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(i, rank, j, d)`` of queries ``(id, v)``; members equal to a query count."""
        rows, asking = self._built(), stored(self._vectors(queries))
        probes = min(len(self.cells), self.probes or max(1, round(SHARE * len(self.cells))))
        spark, metric, again = rows.sparkSession, self.metric, AGAIN * k
        cells, words = spark.sparkContext.broadcast(self.cells), spark.sparkContext.broadcast(self.words)
        asked = stored(looking(asking.withColumnRenamed("id", "qid"), cells, probes, metric))

        def meant(p: pd.DataFrame) -> np.ndarray:
            code = np.frombuffer(b"".join(p["code"]), np.uint8).reshape(len(p), -1)
            return cells.value[p["cell"].to_numpy()] + np.concatenate([w[code[:, m]] for m, w in enumerate(words.value)], axis=1)

        rough = in_blocks(asked, rows.select(F.col("id").alias("vid"), "code", "cell"), again, "euclidean", meant, TASK_ROWS, _unit if metric == "cosine" else np.asarray)
        best = rough.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= again).select("i", "j")
        pairs = best.join(asking.select(F.col("id").alias("i"), "v"), "i").join(rows.select(F.col("id").alias("j"), F.col("v").alias("x")), "j").select("i", "j", "v", "x")

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.record_batch([batch.column("i"), batch.column("j"), pa.array(_distances(_matrix(batch.column("v")), _matrix(batch.column("x")), metric))], names=["i", "j", "d"])

        return ranked(pairs.mapInArrow(measured, "i long, j long, d double"), k)

    def neighbours(self, k: int) -> DataFrame:
        """``(i, rank, j, d)`` of every member; none is its own neighbour."""
        found = self.search(self._built().select("id", "v"), k + 1)
        return ranked(found.where("i <> j").select("i", "j", "d"), k)

    def save(self, path: str) -> None:
        """Rows, centroids and settings as tables."""
        rows, spark = self._built(), self._built().sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        fitted = [(-1, i, c.tolist()) for i, c in enumerate(self.cells)] + [(m, i, c.tolist()) for m, w in enumerate(self.words) for i, c in enumerate(w)]
        spark.createDataFrame(fitted, "part int, at int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")
        spark.createDataFrame([(self.metric, self.probes, self.seed)], "metric string, probes int, seed int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        meta = spark.read.schema("metric string, probes int, seed int").json(f"{path}/meta").first()
        out = cls(meta["metric"], meta["probes"], meta["seed"])
        parts: dict[int, list[list[float]]] = {}
        for r in spark.read.parquet(f"{path}/fitted").orderBy("part", "at").collect():  # bounded by MOST_CELLS and CODE * WORDS
            parts.setdefault(r["part"], []).append(r["c"])
        out.cells, out.words = np.array(parts.pop(-1)), [np.array(parts[m]) for m in sorted(parts)]
        out.rows = spark.read.parquet(f"{path}/rows")
        return out


