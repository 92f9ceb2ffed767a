"""Labels and values on trees. Trees are edges ``(u, v, w)``, labels ``(id, label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import quantile
from canopy.operators.graph import both_ways
from canopy.operators.pairs import PathIndex
from canopy.operators.tree import path
from canopy.storage import stored


def labelled(tree: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Each edge with its ends' values, ``<name>_u`` and ``<name>_v``; a node without one is an error."""
    v = values.select(F.col(values.columns[0]).alias("_id"), F.col(values.columns[1]).alias("_x"))
    out = tree
    for end in ("u", "v"):
        side = v.select(F.col("_id").alias(end), F.col("_x").alias(f"{name}_{end}"), F.lit(True).alias("_has"))
        out = out.join(side, end, "left")
        out = out.withColumn(f"{name}_{end}", F.when(F.col("_has"), F.col(f"{name}_{end}")).otherwise(F.raise_error(F.concat(F.lit("no value for node "), F.col(end))).cast(side.schema[f"{name}_{end}"].dataType))).drop("_has")
    return out


def boundary_edges(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends differ in label."""
    return labelled(tree, labels, "label").where("label_u <> label_v")


def confusion(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label_a, label_b, n)``, symmetric; an edge within a label adds 2 to its own count."""
    e = labelled(tree, labels, "label")
    ways = e.select(F.col("label_u").alias("label_a"), F.col("label_v").alias("label_b")).unionByName(e.select(F.col("label_v").alias("label_a"), F.col("label_u").alias("label_b")))
    return ways.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def edge_delta(tree: DataFrame, values: DataFrame) -> DataFrame:
    """``(u, v, delta)``, how far the ends' values are apart."""
    return labelled(tree, values, "x").select("u", "v", F.abs(F.col("x_u") - F.col("x_v")).alias("delta"))


def path_properties(rooted_forest: DataFrame, a: int, b: int, values: DataFrame) -> DataFrame:
    """``(pos, node, value)`` along a path."""
    v = values.select(F.col(values.columns[0]).alias("node"), F.col(values.columns[1]).alias("value"))
    return path(rooted_forest, a, b).join(v, "node", "left").select("pos", "node", "value").orderBy("pos")


def diversity(tree: DataFrame, nodes: DataFrame, method: str = "mean") -> DataFrame:
    """Mean, max or median weight of each node's edges; 0 for isolated nodes."""
    how = {"mean": F.avg, "max": F.max, "median": F.median}
    if method not in how:
        raise ValueError(f"method must be one of {sorted(how)}")
    found = both_ways(tree).groupBy(F.col("a").alias("node")).agg(how[method]("w").alias("diversity"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).join(found, "node", "left").select("node", F.coalesce("diversity", F.lit(0.0)).alias("diversity"))


def purity(rooted_forest: DataFrame, labels: DataFrame, min_size: int = 10) -> DataFrame:
    """``(node, size, purity)``: the commonest label's share below and at each node, null for subtrees under ``min_size``.

    A subtree is an interval of depth-first places, so a label's count in it is the difference of two running counts. There are two rows for each such node and label of its tree, however deep it is. Nodes without a label count in the size only.
    """
    lab = labels.select(F.col(labels.columns[0]).alias("node"), F.col(labels.columns[1]).alias("label"))
    placed = rooted_forest.join(lab, "node").select("root", "label", F.col("dfs").alias("at"), F.lit(None).cast("long").alias("node"), F.lit(1).alias("one"))
    big = rooted_forest.where(F.col("size") >= min_size).select("root", "node", "dfs", "size")
    asked = big.join(placed.select("root", "label").distinct(), "root")
    ends = F.array(F.struct(F.col("dfs").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("dfs") + F.col("size")).alias("at"), F.lit(1).alias("sign")))
    asked = asked.select("root", "label", "node", F.explode(ends).alias("e")).select("root", "label", "e.at", "node", F.lit(0).alias("one"), "e.sign")
    rows = placed.withColumn("sign", F.lit(0)).unionByName(asked)
    # Labels at places before an end; those at it come later
    running = rows.withColumn("c", F.sum("one").over(Window.partitionBy("root", "label").orderBy("at", "one")))
    n = running.where("sign <> 0").groupBy("node", "label").agg(F.sum(F.col("c") * F.col("sign")).alias("n"))
    top = n.groupBy("node").agg(F.max("n").alias("n"))
    return rooted_forest.select("node", "size").join(top, "node", "left").select("node", "size", F.when(F.col("n") > 0, F.col("n") / F.col("size")).alias("purity"))


def boundary_rate(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """Q1: ``(edges, boundary, rate)``."""
    e = labelled(tree, labels, "label")
    return e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("label_u") != F.col("label_v")).alias("boundary"), F.avg((F.col("label_u") != F.col("label_v")).cast("double")).alias("rate"))


def purity_summary(pure: DataFrame) -> DataFrame:
    """Q2."""
    return pure.agg(F.avg("purity").alias("mean"), F.lit(quantile(pure, "purity", 0.5)).cast("double").alias("median"), F.min("purity").alias("least"), F.count("purity").alias("n"))


def top_label_pairs(tree: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Q3: pairs of labels that most edges join, each edge once."""
    e = boundary_edges(tree, labels)
    pairs = e.groupBy(F.least("label_u", "label_v").alias("label_a"), F.greatest("label_u", "label_v").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.desc("n"), "label_a", "label_b").limit(k)


def label_route(rooted_forest: DataFrame, labels: DataFrame, from_label, to_label) -> DataFrame:
    """Q4: ``(pos, node, label)`` where the label changes along the path between the first nodes of two labels."""
    i, lab = labels.columns[:2]
    ends = labels.where(F.col(lab).isin(from_label, to_label)).groupBy(lab).agg(F.min(i)).collect()
    first = dict(tuple(r) for r in ends)
    steps = path_properties(rooted_forest, first[from_label], first[to_label], labels)
    before = F.lag("value").over(Window.orderBy("pos"))  # a path is short
    return steps.withColumn("b", before).where("b IS NULL OR b <> value").select("pos", "node", F.col("value").alias("label"))


def coherence(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """Q5: ``(label, internal, boundary, share)``: of the edges that touch a label, those that leave it."""
    e = labelled(tree, labels, "label")
    ends = e.select("label_u", "label_v", F.explode(F.array_distinct(F.array("label_u", "label_v"))).alias("label"))
    out = ends.groupBy("label").agg(F.count_if(F.col("label_u") == F.col("label_v")).alias("internal"), F.count_if(F.col("label_u") != F.col("label_v")).alias("boundary"))
    return out.withColumn("share", F.coalesce(F.try_divide("boundary", F.col("internal") + F.col("boundary")), F.lit(0.0)))


def steep_edges(tree: DataFrame, values: DataFrame, share: float = 0.99) -> DataFrame:
    """Q6: edges whose ends differ by more than the quantile of all edges (linear interpolation)."""
    d = stored(edge_delta(tree, values))
    return d.where(F.col("delta") > F.lit(quantile(d, "delta", share)))


def failure_paths(rooted_forest: DataFrame, predictions: DataFrame, values: DataFrame, per_class: int = 20, top: int = 5) -> DataFrame:
    """Q7: ``(node, to, hops, least)``: for each wrong prediction ``(id, label, predicted)``, the fewest hops to one of the first ``per_class`` right ones of its label, and the least value on that path; the ``top`` longest."""
    wrong = predictions.where("label <> predicted").select(F.col("id").alias("node"), "label")
    w = Window.partitionBy("label").orderBy("id")
    right = predictions.where("label = predicted").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_class).select(F.col("id").alias("to"), "label")
    pairs = wrong.join(right, "label").select(F.col("node").alias("a"), F.col("to").alias("b"))
    index = PathIndex(rooted_forest)
    known = index.nodes.select("node")
    for end in ("a", "b"):
        pairs = pairs.join(known.withColumnRenamed("node", end), end, "left_semi")
    # Of each pair the count of edges alone, from the lowest common ancestor; nodes on the way of the few that are left
    met = index.meeting(pairs).where("hops IS NOT NULL")
    best = met.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("hops", F.col("b").alias("to"))).alias("m")).select("node", "m.*")
    far = stored(best.orderBy(F.desc("hops"), "node").limit(top))
    v = values.select(F.col(values.columns[0]).alias("node"), F.col(values.columns[1]).alias("value"))
    way = index.paths(far.select(F.col("node").alias("a"), F.col("to").alias("b"))).join(v, "node")
    least = way.groupBy(F.col("a").alias("node")).agg(F.min("value").alias("least"))
    return far.join(least, "node", "left").select("node", "to", "hops", "least")


def mislabelled(predictions: DataFrame, k: int = 10) -> DataFrame:
    """Q8: wrong predictions ``(id, label, predicted, confidence)``, the surest first."""
    return predictions.where("label <> predicted").orderBy(F.desc("confidence"), "id").limit(k)
