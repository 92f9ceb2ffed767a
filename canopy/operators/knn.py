"""Exact nearest neighbours. Graphs are rows ``(i, rank, j, d)``, rank from 1, ties by j."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.overlap import overlapping
from canopy.schema import InputKind, check
from canopy.storage import stored

GRAPH = "i long, rank int, j long, d double"
#: Bytes of vectors that go to every executor; beyond them blocks meet in a shuffle.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 16_384
#: As ``BROADCAST_BYTES``, for dense vectors: each worker of an executor holds them.
VECTOR_BYTES = 16 << 20
#: Queries and points between which distances are held at once.
QUERIES, POINTS = 256, 4096
#: Pairs whose distances are taken at once.
PAIRS = 1 << 15
#: Entries of a matrix that a task holds before it keeps the nearest of each row.
MATRIX_ROWS = 1 << 20
#: Sets of members from 0 to under so many are compared as rows of bits if they have a share of them like this or more.
BITS, DENSE = 8192, 0.02
BIT_ROWS, BIT_QUERIES = 8192, 128


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _first(row: np.ndarray, d: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(row, rank, d, j)`` of the k least of each row by (d, j), rank from 0."""
    by = np.lexsort((j, d, row))
    row = row[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], rank[keep], d[by][keep], j[by][keep]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str, skip_self: bool, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Rows (i, rank, j, d) of the k nearest in ``x`` of each query, ``ids`` ascending. Zero vectors are at cosine distance 1 from all. Distances are held of ``QUERIES`` queries to ``POINTS`` points at a time, whatever the number of either. Unit vectors are compared in single precision first, and what may be among the nearest again in double. best: lists ``(d, j)`` of k places for each query, of other points, which are brought up to date.
    """
    k = min(k, len(ids)) if best is None else best[0].shape[1]
    if k < 1 or not len(q_ids):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.float64))
    cosine = metric == "cosine"
    rounding = 8 * max(8, x.shape[1]) * np.finfo(np.float32 if cosine else float).eps
    best_d, best_j = best or (np.full((len(q_ids), k), np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max))
    for a in range(0, len(ids), POINTS):
        there, points = ids[a : a + POINTS], x[a : a + POINTS]
        base = _unit(points) if cosine else points
        # One product gives distances less what is the same for all points of a query
        square = (points * points).sum(axis=1)
        factor = -base.T.astype(np.float32) if cosine else np.concatenate((-2 * points, square[:, None]), axis=1).T
        for b in range(0, len(q_ids), QUERIES):
            rows = slice(b, b + QUERIES)
            part, asking = q[rows], q_ids[rows]
            unit = _unit(part) if cosine else part
            near = unit.astype(np.float32) @ factor if cosine else np.concatenate((part, np.ones((len(part), 1))), axis=1) @ factor
            if skip_self:
                order = np.minimum(np.searchsorted(there, asking), len(there) - 1)
                same = there[order] == asking
                near[np.flatnonzero(same), order[same]] = np.inf
            # All within rounding of the k-th best: more than k at one distance are told apart by id
            norm = np.linalg.norm(part, axis=1)
            slack = rounding if cosine else rounding * (np.sqrt(square.max()) + norm) ** 2
            cut = best_d[rows, -1] - 1 if cosine else best_d[rows, -1] ** 2 - norm**2
            short = np.isinf(cut)
            if short.any() and near.shape[1] >= k:
                cut = np.where(short, np.partition(near, k - 1, axis=1)[:, k - 1], cut)
            row, col = np.divmod(np.flatnonzero(near <= (cut + slack)[:, None].astype(near.dtype)), near.shape[1])
            real = np.isfinite(near[row, col])
            row, col = row[real], col[real]
            # Distances again, from differences, so that close points don't lose digits
            d = np.empty(len(row))
            for s in range(0, len(row), PAIRS):
                r, c = row[s : s + PAIRS], col[s : s + PAIRS]
                d[s : s + PAIRS] = 1 - (unit[r] * base[c]).sum(axis=1) if cosine else np.sqrt(((part[r] - points[c]) ** 2).sum(axis=1))
            # Points come by id, so that what is as far as the k-th so far is behind it, unless that is of other points
            less = d < best_d[b + row, -1] if best is None else d <= best_d[b + row, -1]
            row, col, d = row[less], col[less], d[less]
            touched = np.unique(row)
            had = np.repeat(touched, k)
            row, rank, d, j = _first(np.concatenate((row, had)), np.concatenate((d, best_d[b + touched].reshape(-1))), np.concatenate((there[col], best_j[b + touched].reshape(-1))), k)
            best_d[b + row, rank], best_j[b + row, rank] = d, j
    row, rank = np.nonzero(np.isfinite(best_d))
    return q_ids[row], (rank + 1).astype(np.int32), best_j[row, rank], best_d[row, rank]


def nearest_of_blocks(q: pa.Table, p: pa.Table, k: int, metric: str, skip_self: bool) -> pa.Table:
    """``nearest`` of a block of queries ``(id, v)`` in a block of points ``(pid, pv)``. Of either block there is what Arrow holds, and of the points one copy in order of id; queries are taken a batch at a time."""
    ids = p["pid"].to_numpy()
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids)] = np.arange(len(ids))
    x, at = np.zeros((len(ids), 0)), 0
    for batch in p.select(["pv"]).to_batches():
        part = _matrix(batch.column(0))
        if not at and len(part):
            x = np.empty((len(ids), part.shape[1]))
        x[place[at : at + len(part)]] = part
        at += len(part)
    ids = np.sort(ids)
    found = [nearest(b.column(0).to_numpy(), _matrix(b.column(1)), ids, x, k, metric, skip_self) for b in q.select(["id", "v"]).to_batches() if b.num_rows]
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["i", "rank", "j", "d"])


def exact_knn(points: DataFrame, k: int, metric: str = "cosine", queries: DataFrame | None = None, broadcast_bytes: int = VECTOR_BYTES) -> DataFrame:
    """The k nearest of ``points (id, v)`` for each query (each point itself, if None, but not itself).

    Points go to every executor if their size, which is checked, allows; otherwise blocks of queries meet blocks of points, each pair in one task, and best lists are merged.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"metric {metric} has no vectors")
    n = check(points, InputKind.DENSE)
    itself = queries is None
    if k < 1 or (itself and k >= n):
        raise ValueError(f"k must be at least 1 and less than the {n} points")
    pts = points.select(F.col(points.columns[0]).cast("long").alias("id"), F.col(points.columns[1]).alias("v"))
    qs = pts if itself else queries.select(F.col(queries.columns[0]).cast("long").alias("id"), F.col(queries.columns[1]).alias("v"))
    width = pts.select(F.size("v")).first()[0] if n else 0
    if n * width * 8 <= broadcast_bytes:
        table = pts.toArrow().sort_by("id")
        shared = pts.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _matrix(table["v"])))

        def search(batches):
            ids, x = shared.value
            for batch in batches:
                found = nearest(batch.column(0).to_numpy(), _matrix(batch.column(1)), ids, x, k, metric, itself)
                yield pa.record_batch([pa.array(c) for c in found], names=["i", "rank", "j", "d"])

        cores = pts.sparkSession.sparkContext.defaultParallelism
        return qs.repartition(cores).mapInArrow(search, GRAPH) if n * width > 1 << 18 else qs.mapInArrow(search, GRAPH)
    # Blocks grow with the number of points up to a bound, since each row is copied once for each block it meets
    blocks = max(-(-n // (4 * BLOCK_ROWS)), min(-(-n // BLOCK_ROWS), 8))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = qs.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("pb", every)
    # Own names: both sides may come from one table
    right = pts.select(F.col("id").alias("pid"), F.col("v").alias("pv"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("pb")).withColumn("qb", every)

    met = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(lambda q, p: nearest_of_blocks(q, p, k, metric, itself), GRAPH)
    return ranked(met.drop("rank"), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each i among ``(i, j, d)``, by (d, j)."""
    w = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "rank", "j", "d")


def knn_from_matrix(distances: DataFrame, k: int) -> DataFrame:
    """From a full matrix ``(i, j, d)``; the diagonal doesn't count.

    The matrix is read once and never sorted or written: each task keeps the k nearest of each row that it sees, and the lists of all tasks are merged.
    """

    def least(batches):
        ids, cut = np.zeros(0, np.int64), np.zeros(0)
        best = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64)]
        held: list[list[np.ndarray]] = []
        bad = size = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                i, j, d = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                bad += int((~np.isfinite(d)).sum())
                if len(ids) and len(i):
                    at = np.minimum(np.searchsorted(ids, i), len(ids) - 1)
                    keep = ((ids[at] != i) | (d <= cut[at])) & (i != j)
                else:
                    keep = np.ones(len(i), bool)
                held.append([i[keep], d[keep], j[keep]])
                size += int(keep.sum())
            if size >= MATRIX_ROWS or (batch is None and held):
                i, d, j = (np.concatenate([x[c] for x in [best, *held]]) for c in range(3))
                ids = np.union1d(ids, i)
                other = (i != j) & np.isfinite(d)
                row, _, d, j = _first(i[other], d[other], j[other], k)
                best, held, size = [row, d, j], [], 0
                cut = np.full(len(ids), np.inf)
                full = np.flatnonzero(np.bincount(np.searchsorted(ids, row), minlength=len(ids)) == k)
                cut[full] = d[np.searchsorted(row, ids[full], "right") - 1]
        row, d, j = best
        # Rank 0 tells of a row that was seen, rank -1 how many distances aren't finite
        rows = np.concatenate((row, ids, [-1])), np.repeat([1, 0, -1], [len(row), len(ids), 1]), np.concatenate((j, ids, [bad])), np.concatenate((d, np.zeros(len(ids) + 1)))
        yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(rows, (np.int64, np.int32, np.int64, np.float64), strict=True)], names=["i", "rank", "j", "d"])

    parts = stored(distances.select(F.col("i").cast("long"), F.col("j").cast("long"), F.coalesce(F.col("d").cast("double"), F.lit(float("nan"))).alias("d")).mapInArrow(least, GRAPH))
    n, bad = parts.agg(F.count_distinct(F.when(F.col("rank") == 0, F.col("i"))), F.sum(F.when(F.col("rank") == -1, F.col("j")))).first()
    if bad:
        raise ValueError("distances must be finite")
    if n < 2 or not 1 <= k < n:
        raise ValueError(f"k must be at least 1 and less than the {n} rows")
    return ranked(parts.where("rank > 0").select("i", "j", "d"), k)


def graph_from_arrays(rows: DataFrame) -> DataFrame:
    """``(i, indices, distances)`` to a graph; -1 marks an empty slot."""
    checked = rows.select("i", F.when(F.size("indices") == F.size("distances"), F.arrays_zip("indices", "distances")).otherwise(F.raise_error(F.lit("indices and distances differ in length"))).alias("z"))
    flat = checked.select(F.col("i").cast("long").alias("i"), F.posexplode("z").alias("p", "z"))
    return flat.where("z.indices >= 0").select("i", (F.col("p") + 1).cast("int").alias("rank"), F.col("z.indices").cast("long").alias("j"), F.col("z.distances").cast("double").alias("d"))


def jaccard_knn(sets: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Exact Jaccard distance over an inverted index ``member -> queries``.

    Only pairs that share a member are neighbours; sets that share none are at distance 1 and left out. The index goes to every executor by blocks of queries of bounded size, each of which all sets pass by (see ``overlap``). Dense sets of small members, as of fingerprints, are compared as rows of bits in blocks instead.
    """
    itself = queries is None
    id_col, set_col = sets.columns[:2]
    own = sets.select(F.col(id_col).cast("long").alias("j"), F.array_distinct(set_col).alias("s"))
    asked = own.select(F.col("j").alias("i"), "s") if itself else queries.select(F.col(queries.columns[0]).cast("long").alias("i"), F.array_distinct(queries.columns[1]).alias("s"))
    element = sets.schema[set_col].dataType.elementType.simpleString()
    bits = F.max(F.when(F.array_min("s") < 0, F.lit(1 << 40)).otherwise(F.array_max("s").cast("long")))
    top, n, total = own.agg(bits, F.count(F.lit(1)), F.sum(F.size("s"))).first() if element != "string" else (None, 0, 0)
    if top is not None and top < BITS and total >= DENSE * n * (top + 1):
        return _jaccard_by_bits(own, asked, k, itself, top + 1, n)
    return overlapping(own, asked, k, itself)


def nearest_bits(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, ...]:
    """Rows (i, rank, j, d) of the k nearest of each query by Jaccard distance among packed rows ``x`` that share a bit with it."""
    n_q, n_x = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (q, x))
    best_d, best_j = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for a in range(0, len(x), BIT_ROWS):
        block, there, size = np.unpackbits(x[a : a + BIT_ROWS], axis=1).astype(np.float32).T, ids[a : a + BIT_ROWS], n_x[a : a + BIT_ROWS]
        for b in range(0, len(q), BIT_QUERIES):
            rows = slice(b, b + BIT_QUERIES)
            common = (np.unpackbits(q[rows], axis=1).astype(np.float32) @ block).astype(np.float64)
            with np.errstate(invalid="ignore"):
                d = np.where(common > 0, 1.0 - common / (n_q[rows, None] + size[None] - common), np.inf)
            if itself:
                d[q_ids[rows, None] == there[None]] = np.inf
            take = min(k, d.shape[1])
            cut = np.minimum(np.partition(d, take - 1, axis=1)[:, take - 1], best_d[rows, -1])
            row, col = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
            if not len(row):
                continue
            # What is at the k-th distance or nearer, with the best so far, by (distance, id)
            row = np.concatenate((row, np.repeat(np.arange(len(d)), k)))
            dist, j = np.concatenate((d[row[: len(col)], col], best_d[rows].reshape(-1))), np.concatenate((there[col], best_j[rows].reshape(-1)))
            by = np.lexsort((j, dist, row))
            row, dist, j = row[by], dist[by], j[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            best_d[b + row[keep], rank[keep]], best_j[b + row[keep], rank[keep]] = dist[keep], j[keep]
    row, rank = np.nonzero(np.isfinite(best_d))
    return q_ids[row], (rank + 1).astype(np.int32), best_j[row, rank], best_d[row, rank]


def _jaccard_by_bits(own: DataFrame, asked: DataFrame, k: int, itself: bool, width: int, n: int) -> DataFrame:
    """Sets as packed bits, which go to every executor if that many bytes are few, or else meet in blocks, each pair in one task."""
    size = -(-width // 8)

    def packed(df: DataFrame, name: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                sets = batch.column(1)
                length = pa.compute.list_value_length(sets).fill_null(0).to_numpy(zero_copy_only=False)
                flat = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(length)), length)
                # Members that no set searched has are only counted
                far = flat >= width
                bits = np.zeros((len(length), width), bool)
                bits[row[~far], flat[~far]] = True
                more = np.bincount(row[far], minlength=len(length))
                yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()), pa.array(more)], names=[name, "bits", "more"])

        return df.select(df.columns[0], "s").mapInArrow(run, f"{name} long, bits binary, more long")

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, size)

    def found(i: np.ndarray, q: np.ndarray, more: np.ndarray, j: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        if more.any():  # a column of its own for each foreign member, which no row searched has
            extra = np.zeros((len(q), -(-int(more.max()) // 8) * 8), bool)
            extra[np.arange(extra.shape[1])[None] < more[:, None]] = True
            q, x = np.concatenate((q, np.packbits(extra, axis=1)), axis=1), np.concatenate((x, np.zeros((len(x), extra.shape[1] // 8), np.uint8)), axis=1)
        return nearest_bits(i, q, j, x, k, itself)

    cores = own.sparkSession.sparkContext.defaultParallelism
    points, queries = packed(own, "j"), packed(asked, "i").repartition(cores)
    if n * size <= BROADCAST_BYTES:
        table = points.toArrow().sort_by("j")
        shared = own.sparkSession.sparkContext.broadcast((table["j"].to_numpy(), matrix(table["bits"].to_pylist())))

        def search(batches):
            held: list[pa.RecordBatch] = []
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    held.append(batch)
                if held and (batch is None or sum(b.num_rows for b in held) >= BLOCK_ROWS):
                    part, held = pa.Table.from_batches(held), []
                    rows = found(part["i"].to_numpy(), matrix(part["bits"].to_pylist()), part["more"].to_numpy(), *shared.value)
                    yield pa.record_batch([pa.array(c) for c in rows], names=["i", "rank", "j", "d"])

        return queries.mapInArrow(search, GRAPH)
    blocks = -(-n // (4 * BLOCK_ROWS))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")).withColumn("pb", every)
    right = points.select("j", F.col("bits").alias("pbits"), F.pmod(F.xxhash64("j"), F.lit(blocks)).cast("int").alias("pb")).withColumn("qb", every)

    def pair(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"i": [], "rank": [], "j": [], "d": []})
        i, rank, j, d = found(q["i"].to_numpy(), matrix(q["bits"]), q["more"].to_numpy(), p["j"].to_numpy(), matrix(p["pbits"]))
        return pd.DataFrame({"i": i, "rank": rank, "j": j, "d": d})

    met = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(pair, GRAPH)
    return ranked(met.drop("rank"), k)


def recall(true: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(n, hits, recall)``: the share of true neighbours that were found."""
    n = true.select(F.count_distinct("i").alias("n"))
    hits = true.join(found.select("i", "j"), ["i", "j"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return n.crossJoin(hits).select("n", "hits", (F.col("hits") / (F.col("n") * k)).alias("recall"))
