"""Merkle manifests of datasets, with a proof for each row.

A tree stands over the rows of each group in order; trees of groups stand in a tree of their own, whose root is the dataset's. Every node is the hash of up to ``FAN`` children. A block holds ``FAN ** DEPTH`` consecutive nodes of a level, aligned, so that it is a whole subtree. A task walks a block in postorder: it returns the subtree's digest and, while it unwinds, appends the siblings of each child to the proofs of the leaves below that child. Roots of blocks are the nodes of the next distributed traversal, until one is left; the proofs it gives them are appended to those of their leaves. So a dataset of n rows takes log(n) / log(FAN ** DEPTH) traversals, a task holds one block at a time, and a group of any size is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from canopy.llm.durable import durable

#: Children of a node, and levels of nodes in a block.
FAN, DEPTH = 8, 3


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(nodes: int, depth: int) -> int:
    """Levels above ``nodes`` nodes within a block: until one is left, ``depth`` at most."""
    levels = 0
    while nodes > 1 and levels < depth:
        nodes = -(-nodes // FAN)
        levels += 1
    return levels


def walk(nodes: list[str], low: int, levels: int, proofs: list[list[str]] | None) -> str:
    """Digest of the subtree over ``nodes[low : low + FAN ** levels]``; siblings go to the proofs of the nodes below each child."""
    if not levels:
        return nodes[low]
    width = FAN ** (levels - 1)
    starts = range(low, min(low + FAN * width, len(nodes)), width)
    children = [walk(nodes, at, levels - 1, proofs) for at in starts]
    if proofs is not None and len(children) > 1:
        for i, at in enumerate(starts):
            others = "".join(children[:i] + children[i + 1 :])
            for own in proofs[at : at + width]:
                own.append(others)
    return digest(children)


def ordered(rows: DataFrame, group: str, by: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 in order of ``by`` within each group) and ``places``. Ranges of rows are sorted each by itself, and a group's part of a range begins where those before it end."""
    ranged = durable(rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    parts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    # A row for each group and range that has some of it
    listed = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_part", "_n", "_low"))).alias("_l"), F.sum("_n").alias("places"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<_part:bigint,_shift:bigint>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["sum"] + p["_n"]).alias("sum"), F.concat(acc["out"], F.array(F.struct(p["_part"].alias("_part"), (acc["sum"] - p["_low"]).alias("_shift")))).alias("out"))

    shifts = durable(listed.select(group, "places", F.explode(F.aggregate("_l", zero, add)["out"]).alias("s")).select(group, "places", "s.*"))
    return ranged.join(shifts, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """``(tree, places, block, nodes)`` from nodes ``(tree, place, places, digest, more)``: the nodes of each block in order."""
    block = F.floor(F.col("place") / FAN**depth).alias("block")
    return durable(nodes.groupBy("tree", "places", block).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "more"))).alias("nodes")), wide=True)


def block_roots(held: DataFrame, depth: int) -> DataFrame:
    """``(tree, place, places, digest)``: the root of each block as a node of the next traversal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [walk(nodes, 0, height(n, depth), None) for n, nodes in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            size = batch.column(1).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.maximum(-(-size // FAN**depth), 1)), pa.array(roots, pa.string())], names=["tree", "place", "places", "digest"])

    return held.select("tree", "places", "block", F.col("nodes.digest").alias("d")).mapInArrow(run, "tree string, place long, places long, digest string")


def unwound(held: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Nodes ``(place, places, digest, more)`` of the blocks with what stands above them: ``subroot``, ``root``, ``group_place``, ``group_places`` and ``proof``, to which the siblings within the block are put in front."""
    upper = above.select("tree", F.col("place").alias("block"), "subroot", "root", "group_place", "group_places", "proof")
    met = held.join(upper, ["tree", "block"]).select("places", "nodes", "subroot", "root", "group_place", "group_places", "proof")
    more = held.schema["nodes"].dataType.elementType["more"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, above = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(2, 7)]
            for i in range(batch.num_rows):
                nodes = batch.column(1)[i].values
                digests = nodes.field("digest").to_pylist()
                proofs: list[list[str]] = [[] for _ in digests]
                walk(digests, 0, height(size[i], depth), proofs)
                subroot, root, place, places, proof = (c[i] for c in above)
                n = len(digests)
                long = pa.int64()
                yield pa.record_batch(
                    [nodes.field("place"), pa.array([size[i]] * n, long), nodes.field("digest"), nodes.field("more"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                     pa.array([place] * n, long), pa.array([places] * n, long), pa.array(["".join(own) + proof for own in proofs], pa.string())],
                    names=["place", "places", "digest", "more", "subroot", "root", "group_place", "group_places", "proof"],
                )

    return met.mapInArrow(run, f"place long, places long, digest string, more {more}, subroot string, root string, group_place long, group_places long, proof string")


def climb(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """Nodes ``(tree, place, places, digest, more)`` with proofs (see ``unwound``). crown: what stands above the roots of trees ``(tree, digest)``."""
    held = blocks(nodes, depth)
    roots = durable(block_roots(held, depth))
    if roots.where("places > 1").isEmpty():
        above = crown(roots).withColumn("place", F.lit(0).cast("long"))
    else:
        own = climb(roots.withColumn("more", F.struct("tree")), crown, depth)
        above = own.select("more.tree", "place", "subroot", "root", "group_place", "group_places", "proof")
    return unwound(held, above, depth)


def bare(roots: DataFrame) -> DataFrame:
    """Nothing stands above the tree of groups."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return roots.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), zero.alias("group_place"), one.alias("group_places"), F.lit("").alias("proof"))


def grouped(roots: DataFrame, depth: int) -> DataFrame:
    """The tree of groups above the roots of their trees, in order of groups."""
    nodes = ordered(roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", ["name"])
    over = climb(nodes.select(F.col("all").alias("tree"), "place", "places", "digest", F.struct("name").alias("more")), bare, depth)
    return over.select(F.col("more.name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("place").alias("group_place"), F.col("places").alias("group_places"), "proof")


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", depth: int = DEPTH) -> DataFrame:
    """``rows`` with ``subroot`` (of the row's group), ``root``, ``proof`` (hex digests of siblings, from the leaf up, left to right) and ``stand``: places of the leaf in its group's tree and of that in the tree of groups, and how many stand in each.

    Leaves (hex digests) of a group stand in order of ids, nulls first, and of leaves where ids are equal; of these, rows that are equal besides are interchangeable. Groups go by the bytes of their names, null first. A tree of one leaf is that leaf. Null leaves are an error; repeated rows are a leaf each; long texts enter by their digest only; an empty table gives no rows. Columns keep their names, whatever they are; one called as a new column gives way to it. depth: levels of a block.
    """
    name = F.col(f"`{group_col}`").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    own = F.coalesce(F.col(f"`{leaf_col}`"), F.raise_error(F.lit("a leaf is null")).cast("string"))
    # '=' before names tells an empty one from null
    nodes = durable(rows.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), F.col(f"`{id_col}`").alias("id"), own.alias("digest"), whole.alias("more")))
    placed = ordered(nodes, "tree", ["id", "digest"])
    out = climb(placed.select("tree", "place", "places", "digest", "more"), lambda roots: grouped(roots, depth), depth)
    new = ("subroot", "root", "proof", "stand")
    kept = [F.col("more")[c].alias(c) for c in rows.columns if c not in new]
    return out.select(*kept, "subroot", "root", "proof", F.struct("place", "places", "group_place", "group_places").alias("stand"))


def fold(claimed: str, proof: str, stand: tuple[int, int, int, int]) -> str:
    """The root that a leaf and the siblings of its proof give."""
    at, node = 0, claimed
    for place, places in (stand[:2], stand[2:]):
        while places > 1:
            run = place // FAN * FAN
            size = min(FAN, places - run)
            others = proof[at : at + 64 * (size - 1)]
            at += len(others)
            cut = 64 * (place - run)
            node = digest([others[:cut], node, others[cut:]])
            place, places = place // FAN, -(-places // FAN)
    return node


def folded(proofs: DataFrame, claimed: str, name: str = "folded_root") -> DataFrame:
    """``proofs`` as ``manifest`` gives them with ``name``: the root recomputed from the leaf in column ``claimed``. It is the manifest's if the row is what the manifest was made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                stand = part.column("stand")
                places = zip(*[stand.field(c).to_pylist() for c in ("place", "places", "group_place", "group_places")], strict=True)
                roots = [fold(c, p, s) for c, p, s in zip(part.column(claimed).to_pylist(), part.column("proof").to_pylist(), places, strict=True)]
                yield part.append_column(name, pa.array(roots, pa.string()))

    return proofs.mapInArrow(run, StructType([*proofs.schema.fields, StructField(name, StringType())]))
