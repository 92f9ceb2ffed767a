"""Coordinates, colours and text values as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.storage import stored


def l2_from_square(d: Column) -> Column:
    """Rounding may leave squares slightly below 0."""
    return F.sqrt(F.greatest(d, F.lit(0.0)))


def normalize(coords: DataFrame) -> DataFrame:
    """X and y centred and scaled by the larger half range, so that the shape stays; a single place goes to 0."""
    a = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    s = a.select(((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.when(half > 0, half).otherwise(1.0).alias("h"))
    return coords.crossJoin(F.broadcast(s)).select(*[c for c in coords.columns if c not in "xy"], ((F.col("x") - F.col("cx")) / F.col("h")).alias("x"), ((F.col("y") - F.col("cy")) / F.col("h")).alias("y"))


def normalize_axes(coords: DataFrame) -> DataFrame:
    """Each axis by itself to [-0.5, 0.5]; a range under 1e-10 counts as 1."""
    a = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def scaled(c: str) -> Column:
        r = F.col(f"{c}1") - F.col(f"{c}0")
        return ((F.col(c) - F.col(f"{c}0")) / F.when(r < 1e-10, 1.0).otherwise(r) - 0.5).alias(c)

    return coords.crossJoin(F.broadcast(a)).select(*[c for c in coords.columns if c not in "xy"], scaled("x"), scaled("y"))


def quantize(c: Column, bits: int = 16) -> Column:
    """[-1, 1] to whole numbers of 16 or 32 bits."""
    if bits not in (16, 32):
        raise ValueError("coordinates are kept in 16 or 32 bits")
    return F.floor((F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)) + 1) * F.lit(((1 << bits) - 1) / 2)).cast("long")


def dequantize(q: Column, bits: int = 16) -> Column:
    """E23."""
    return q * F.lit(2.0 / ((1 << bits) - 1)) - 1


def in_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` 0, 1, ... in order of ``by``: ranges are numbered each by itself, from where the counts of those before them end. No task holds all rows."""
    ranged = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, begins = 0, [(0, 0)]
    for p in sorted(counts):
        begins.append((p, begin - (p << 33)))
        begin += counts[p]
    shift = df.sparkSession.createDataFrame(begins[1:] or [(0, 0)], "_p long, _shift long")
    return ranged.join(F.broadcast(shift), part == F.col("_p")).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")


def quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The exact quantile of a column's values that aren't null, with linear interpolation; None if there are none. Values are sorted in ranges, of which no task holds all."""
    ranked = stored(in_order(df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL"), ["x"], "r"))
    n = ranked.count()
    if not n:
        return None
    low = int(q * (n - 1))
    near = {r["r"]: r["x"] for r in ranked.where(F.col("r").isin(low, low + 1)).collect()}
    return near[low] + (q * (n - 1) - low) * (near.get(low + 1, near[low]) - near[low])


def dictionary(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """``(value, code)``, codes in order of each value's first id."""
    seen = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("")).alias("value")).agg(F.min(id_col).alias("f"))
    return in_order(seen, ["f", "value"], "code").select("value", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """``df`` with ``<col>_code``."""
    d = dictionary(df, id_col, col).withColumnRenamed("code", f"{col}_code")
    return df.withColumn("value", F.coalesce(F.col(col).cast("string"), F.lit(""))).join(d, "value").drop("value")


def obs_to_numeric(c: Column) -> Column:
    """The digits, points and minus signs of a text as a number, null if they are none."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def safe_float(c: Column) -> Column:
    """Numbers of texts; empty, unknown and endless ones are null."""
    d = c.cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def is_categorical(df: DataFrame, col: str, limit: int = 30) -> bool:
    """Texts and booleans; whole numbers of ``limit`` different values at most."""
    kind = df.schema[col].dataType.typeName()
    if kind in ("string", "boolean"):
        return True
    return kind in ("byte", "short", "integer", "long") and df.agg(F.count_distinct(col)).first()[0] <= limit


def colour_position(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``position`` in [0, 1] of finite values, null for others."""
    v = safe_float(F.col(col))
    a = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.crossJoin(F.broadcast(a)).withColumn("position", F.when(span > 0, (v - F.col("_lo")) / span).when(v.isNotNull(), 0.0)).drop("_lo", "_hi")


def running_sum(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before in order of ``by``, which must tell rows apart. Ranges are summed each by itself, from the sum of those before them; no task holds all rows."""
    ranged = stored(df.withColumn("_value", value.cast("double")).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before, begins = 0.0, []
    for r in sorted(ranged.groupBy("_part").agg(F.sum("_value").alias("s")).collect()):
        begins.append((r["_part"], before))
        before += r["s"]
    begin = df.sparkSession.createDataFrame(begins, "_part int, _begin double")
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_value")
    return ranged.join(F.broadcast(begin), "_part").withColumn(name, inside + F.col("_begin")).drop("_part", "_value", "_begin")
