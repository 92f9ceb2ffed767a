"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from canopy.storage import give_back

#: Bytes of a row group of wide rows, and the options that hold the writer to it.
WIDE_BYTES = 16 << 20
WIDE = {"parquet.block.size": WIDE_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: The setting that bounds batches sent to Python, and its value while wide rows are made or read.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="canopy-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives the loss of any executor and has no lineage; files go when the driver exits. ``wide``: rows may have some MB each. Parquet's writer looks at its size only after 100 rows, and its reader takes up to 4,096 of a row group at once; such rows are looked at one by one and written in groups of ``WIDE_BYTES``. What goes to Python meanwhile goes in batches of ``BATCH_BYTES`` and not of Spark's 64 MB, which each task would hold several times over, outside the heap.
    """
    return gathered([df], wide)


def gathered(tables: Iterable[DataFrame], wide: bool = False) -> DataFrame | None:
    """``durable`` for tables of one schema, each written as it comes, that are read back as one; None if there are none."""
    spark = path = None
    for df in tables:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/canopy-{uuid.uuid4().hex}"
            _written.append((spark, path))
        before = spark.conf.get(BATCH, None) if wide else None
        if wide:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        try:
            df.write.mode("append").options(compression="zstd", **(WIDE if wide else {})).parquet(path)
        finally:
            if wide:
                spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
        give_back(spark)
    return None if path is None else spark.read.schema(schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
