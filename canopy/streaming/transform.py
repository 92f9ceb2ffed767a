"""New points as a stream: places against a fitted model, and additions batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, id_col: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def transform_stream(stream: DataFrame, model, path: str, checkpoint: str):
    """M3 of each batch, written to ``path`` under its batch number, so that a batch that runs again writes the same rows to the same place."""

    def batch(points: DataFrame, number: int) -> None:
        if not points.isEmpty():
            model.transform(points).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_stream(stream: DataFrame, model, checkpoint: str, done: Callable[[int], None] | None = None):
    """M4 of each batch, in order. Ids that the model has are left out, so that a batch may run again."""

    def batch(points: DataFrame, number: int) -> None:
        new = points.join(model.embedding_.select(F.col("id").alias(points.columns[0])), points.columns[0], "left_anti")
        if not new.isEmpty():
            model.add_points(new)
        if done is not None:
            done(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, group_col: str, value_col: str, window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and group, with late rows up to ``delay``."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return stream.withWatermark(time_col, delay).groupBy(w, group_col).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"))
