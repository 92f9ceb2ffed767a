"""Cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or on one machine a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="canopy-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = have.get()
    return named.rstrip("/")


def give_back(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed outside its heap to the system.

    Spark starts threads for each exchange and broadcast, and the allocator keeps what they free in some sixty arenas; a run of many short jobs holds hundreds of MB so. Where the JVM has no such command, nothing happens.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    with contextlib.suppress(Exception):
        lang, kind = jvm.java.lang, jvm.java.lang.Class.forName
        # By the interface's method: the server's own class isn't open to callers
        takes = [kind(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *takes))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object, array(lang.String)), array(lang.String, "[Ljava.lang.String;"))
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back. Files go when the driver exits."""
    path = f"{shared_dir(df.sparkSession)}/canopy-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
