"""Filters, search, facets, histograms and exports of a table of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "__other__"


def valid_neighbours(graph: DataFrame) -> DataFrame:
    """rows of a kNN graph that are no empty slots, loops or infinite distances."""
    return graph.where("j >= 0 AND i <> j AND d IS NOT NULL AND NOT isnan(d) AND abs(d) < double('infinity')")


def in_categories(df: DataFrame, col: str, values: list[str], top: int = 15) -> DataFrame:
    """Rows whose text value is listed; ``__other__`` stands for values beyond the ``top`` commonest."""
    c = F.coalesce(F.col(col).cast("string"), F.lit(""))
    keep = c.isin([v for v in values if v != OTHER])
    if OTHER not in values:
        return df.where(keep)
    common = facet_counts(df, col, top).where(F.col("value") != OTHER).select(F.col("value").alias("_v"))
    return df.join(F.broadcast(common), c == F.col("_v"), "left").where(keep | F.col("_v").isNull()).drop("_v")


def in_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """finite values from low to high."""
    return df.where(F.col(col).between(low, high) & ~F.isnan(F.col(col).cast("double")))


def search(df: DataFrame, col: str, query: str, partial: bool = True) -> DataFrame:
    """texts that hold, or are, the trimmed query, in either case."""
    q, c = query.strip().lower(), F.lower(F.col(col))
    return df.where(c.contains(q) if partial else c == q)


def subset(df: DataFrame, id_col: str, ids: DataFrame | None = None, mask: Column | None = None) -> DataFrame:
    """rows of listed ids, or where a condition holds, in order of id."""
    if (ids is None) == (mask is None):
        raise ValueError("give ids or a mask, one of them")
    kept = df.where(mask) if ids is None else df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")
    return kept.orderBy(id_col)


def facet_counts(df: DataFrame, col: str, top: int = 15, id_col: str | None = None) -> DataFrame:
    """A3: ``(value, n)`` of the ``top`` commonest values, ties by first id (or value), and the sum of all others."""
    c = F.coalesce(F.col(col).cast("string"), F.lit(""))
    n = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"), (F.min(id_col) if id_col else F.min(c)).alias("first"))
    best = n.orderBy(F.desc("n"), "first").limit(top)
    rest = n.agg(F.sum("n").alias("all")).crossJoin(best.agg(F.sum("n").alias("shown"))).where("all > shown")
    return best.select("value", "n").unionByName(rest.select(F.lit(OTHER).alias("value"), (F.col("all") - F.col("shown")).alias("n")))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """A4: ``(bin, n)`` of finite values, the last bin closed; nothing if all values are one."""
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    return v.crossJoin(F.broadcast(r)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def export_selection(df: DataFrame, selection: DataFrame, id_col: str, columns: list[str], path: str, sep: str = ",") -> None:
    """Chosen columns of selected rows as CSV or TSV; quotes are doubled."""
    chosen = df.join(selection.select(F.col(selection.columns[0]).alias(id_col)), id_col, "left_semi")
    chosen.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def quotas(sizes: dict[str, int], max_items: int, mode: str = "proportional") -> dict[str, int]:
    """A10: rows to take of each group, groups in order of name.

    proportional: rounded down shares, one at least; then the largest quotas give, or the groups with most rows left get. balanced: equal shares; what groups can't fill goes to those with most rows left.
    """
    names = sorted(sizes)
    total = sum(sizes.values())
    if total <= max_items:
        return dict(sizes)
    if mode == "proportional":
        if len(names) > max_items:
            raise ValueError("more groups than rows to take")
        q = {g: min(sizes[g], max(1, max_items * sizes[g] // total)) for g in names}
        while sum(q.values()) > max_items:
            q[max((g for g in names if q[g] > 1), key=lambda g: q[g])] -= 1
    elif mode == "balanced":
        q, left = dict.fromkeys(names, 0), max_items
        active = [g for g in names if sizes[g]]
        while left and active:
            share = max(1, left // len(active))
            for g in active:
                take = min(sizes[g] - q[g], share, left)
                q[g] += take
                left -= take
            active = [g for g in active if q[g] < sizes[g]]
    else:
        raise ValueError("mode is proportional or balanced")
    while sum(q.values()) < max_items:
        q[max((g for g in names if q[g] < sizes[g]), key=lambda g: sizes[g] - q[g])] += 1
    return q


def stratified_sample(df: DataFrame, id_col: str, group_col: str, max_items: int, seed: int = 42, mode: str = "proportional") -> DataFrame:
    """A10: a sample with quotas, chosen by a seeded hash of the id, so that partitioning doesn't matter. The groups' names and sizes go to the driver."""
    g = F.coalesce(F.col(group_col).cast("string"), F.lit(""))
    sizes = {r["g"]: r["n"] for r in df.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    q = quotas(sizes, max_items, mode)
    take = df.sparkSession.createDataFrame(sorted(q.items()) or [("", 0)], "_take string, _quota long")
    w = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    # No group gives more than the largest quota, which Spark cuts each part of a group to before it is moved
    ranked = df.withColumn("_g", g).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(q.values(), default=0))
    return ranked.join(F.broadcast(take), F.col("_g") == F.col("_take")).where("_r <= _quota").drop("_g", "_r", "_take", "_quota")
