"""Sharding by jump consistent hashing, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.durable import durable

#: Draws computed for a key. A key jumps about ln(shards) times; with as many draws as shards, or with any fixed number, appending shards still moves keys into the new shards only.
MAX_DRAWS = 64


def jumps(key: Column, shards: int) -> Column:
    """The shards below ``shards`` that the key jumps through, in rising order; the last one is its shard.

    The generator that the key seeds is XXH64 of key and step. After shard b the next one is floor((b + 1) / r) for a draw r from (0, 1].
    """
    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_DRAWS)))
    start = F.array(F.lit(0).cast("long"))

    def jump(path: Column, step: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, step), 33) + 1) / F.lit(float(1 << 31))
        to = F.floor((F.element_at(path, -1) + 1) / draw)
        return F.when((F.element_at(path, -1) < shards), F.concat(path, F.array(to.cast("long")))).otherwise(path)

    # The first draw belongs to shard 0, so that paths begin there.
    return F.filter(F.aggregate(steps, start, jump), lambda b: b < shards)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of each document.

    size: UTF-8 bytes of the text and 1; a null text has none and a CRC of 0. Law ``key``: the id and the number of shards decide; ``grown_shard`` is the shard with one more, which takes rows only into itself. A null id is a key like others; equal ids share a shard. slot: 0, 1, ... in each shard. An empty table gives no rows; other columns don't matter.

    Slots come from counts: rows are numbered within small blocks of a shard, and blocks begin where the counts of those before them end, so that no task holds a shard.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000null"))
    path = jumps(key, shards + 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), path.alias("path"))
    rows = rows.select(
        "id", "size", "text_crc32", F.lit("key").alias("law"),
        F.array_max(F.filter("path", lambda b: b < shards)).cast("int").alias("shard"), F.array_max("path").cast("int").alias("grown_shard"),
    )
    return numbered(rows, ["shard"], "slot").select(F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with ``name`` 0, 1, ... in each group of ``by``; no group meets in one task.

    The task that reads a row and the row's place there number it; counts of tasks and groups, a few rows each, give where each begins.
    """
    at = durable(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", 33))
    sub = F.shiftright(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), 12)  # 4096 rows of a task
    at = at.withColumn("_block", (F.col("_task") * F.lit(1 << 21) + sub))
    counts = at.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    begins = counts.withColumn("_begin", F.sum("_n").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_n")).drop("_n")
    inner = Window.partitionBy(*by, "_block").orderBy("_at")
    return at.withColumn("_k", F.row_number().over(inner) - 1).join(begins, [*by, "_block"]).withColumn(name, (F.col("_begin") + F.col("_k")).cast("long")).drop("_at", "_task", "_block", "_k", "_begin")
