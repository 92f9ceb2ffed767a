"""Packing documents into sequences: a grouping genetic algorithm on islands.

Documents are dealt by hash into blocks of bounded size. Each island evolves a population of packings of a block: a crossover takes whole well-filled bins of one parent, drops the other parent's bins that share documents with them, and best-fits the documents displaced. After each epoch every island hands its elite to the next one. Islands are tasks, epochs are jobs; only lengths and assignments move.

A block wastes part of a sequence whatever its packing, so full sequences of each block's elite stay, and what is in the others goes to the next level, where the remains of several blocks make up a new one. Levels shrink by about three quarters each.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.text import blocks, segments, text_bytes, then_give_back
from canopy.llm.tokencount import apart
from canopy.llm.transducer import split_texts, vocabulary

PIECES = "uid long, doc_id {}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts: the distinct pieces of a block are merged in one call, their ids are taken for each occurrence."""

    def __init__(self, spec: str) -> None:
        import tiktoken

        tokens, self.added = vocabulary(spec)
        # Pieces are cut before; the pattern takes each as it is, and the NUL between two of them as one of its own
        self.bpe = tiktoken.Encoding("own", pat_str=r"[^\x00]+|\x00", mergeable_ranks=tokens, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=tokens, special_tokens={})
        self.between = tokens.get(b"\0")

    def _ids(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct pieces, joined, and their n + 1 bounds."""
        pieces = vocab.to_pylist()
        if self.between is None or any(b"\0" in p for p in pieces):
            rows = [self.whole.encode_ordinary(p.decode()) for p in pieces]
            bounds = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(r) for r in rows], out=bounds[1:])
            return np.fromiter((i for r in rows for i in r), np.uint32, int(bounds[-1])), bounds
        ids = np.array(self.bpe.encode_ordinary(b"\0".join(pieces).decode()), np.uint32)
        # No token of a piece without NUL has one
        cut = np.flatnonzero(ids == self.between)
        ends = np.append(cut, len(ids)) if pieces else np.zeros(0, np.int64)
        return np.delete(ids, cut), np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, joined, and their n + 1 bounds."""
        parts, owner, extra = apart(column, self.added)
        pieces, first = split_texts(*text_bytes(parts))
        ids, bounds = self._ids(pieces.dictionary)
        code = pieces.indices.to_numpy(zero_copy_only=False)
        size = np.diff(bounds)[code]
        flat = ids[np.repeat(bounds[:-1][code], size) + segments(size)] if len(code) else ids
        ends = np.concatenate(([0], np.cumsum(size)))[first]
        if not extra.any():
            return flat, ends
        text = [[] for _ in extra]
        names = self._added_in(column, extra)
        for p, d in enumerate(owner.tolist()):
            if text[d] or (p and owner[p - 1] == d):
                text[d].append(np.array([names[d].pop(0)], np.uint32))
            text[d].append(flat[ends[p] : ends[p + 1]])
        joined = [np.concatenate(t) if t else np.zeros(0, np.uint32) for t in text]
        return np.concatenate(joined), np.concatenate(([0], np.cumsum([len(j) for j in joined])))

    def _added_in(self, column: pa.Array, extra: np.ndarray) -> dict[int, list[int]]:
        import re

        pattern = "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))
        return {d: [self.added[m] for m in re.findall(pattern, column[d].as_py())] for d in np.flatnonzero(extra).tolist()}


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def pieces(docs: DataFrame, spec: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids, the first one the shorter; ``uid`` numbers them."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 31 bits for the task and 32 for its pieces: a task of 4 billion pieces would exceed any input split.
        uid = TaskContext.get().partitionId() << 32
        coder = encoder(shared.value)
        for batch in batches:
            for part in blocks(batch, "text", 2 << 20):
                flat, bounds = coder.encode(part.column(1))
                size = np.diff(bounds) + 1
                # The end token after each document
                ids = np.full(int(size.sum()), end_id, "<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size - 1)] = flat
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                k = segments(count)
                head = size - (count - 1) * capacity
                start = np.where(k == 0, 0, head[row] + (k - 1) * capacity)
                length = np.where(k == 0, head[row], capacity)
                at = (np.cumsum(size) - size)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(uid + np.arange(len(row))), part.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                uid += len(row)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(then_give_back(run), PIECES.format(kind))


# One packing: bins as lists of item numbers, and what each holds. Items are numbered by falling length.


@dataclass
class Packing:
    bins: list[list[int]]
    fills: list[int]

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean squared fill)."""
        return -len(self.bins), sum(f * f for f in self.fills) / (capacity * capacity * max(1, len(self.bins)))


def best_fit(sizes: list[int], items: list[int], packing: Packing, capacity: int) -> Packing:
    """Put items, in the order given, into the fullest bin that takes each. ``packing`` is extended in place."""
    bins, fills = packing.bins, packing.fills
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        room[capacity - fill].append(b)
        mask |= 1 << (capacity - fill)
    for i in items:
        size = sizes[i]
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
            bins[b].append(i)
            fills[b] += size
            left -= size
        else:
            b = len(bins)
            bins.append([i])
            fills.append(size)
            left = capacity - size
        room[left].append(b)
        mask |= 1 << left
    return packing


def crossover(sizes: list[int], one: Packing, other: Packing, capacity: int, rng: random.Random) -> Packing:
    """Well-filled bins of ``one`` as they are, bins of ``other`` that share no item with them, the rest by best fit in falling or nearly falling order. A few good bins of ``other`` are dissolved too, so that what stands in them can meet what is displaced."""
    well, good, draw = capacity * 0.995, capacity * 0.98, rng.random
    taken = bytearray(len(sizes))
    child = Packing([], [])
    for b, fill in zip(one.bins, one.fills, strict=True):
        if fill >= well and draw() < 0.6:
            child.bins.append(b[:])
            child.fills.append(fill)
            for i in b:
                taken[i] = 1
    loose = []
    for b, fill in zip(other.bins, other.fills, strict=True):
        left = [i for i in b if not taken[i]]
        if len(left) == len(b) and fill >= good and draw() > 0.03:
            child.bins.append(left)
            child.fills.append(fill)
        else:  # poorly filled bins, and those that share items, are dissolved
            loose += left
    order = sorted(loose, key=lambda i: -sizes[i] * (1 + 0.3 * draw())) if draw() < 0.7 else sorted(loose)
    return best_fit(sizes, order, child, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, guest: Packing | None, population: int, generations: int) -> Packing:
    """The elite of an island after some generations. It never has more bins than best fit decreasing gives."""
    rng = random.Random(seed)
    order = list(range(len(sizes)))
    herd = [best_fit(sizes, order, Packing([], []), capacity)]
    bound = -(-sum(sizes) // capacity)
    if guest is not None:
        herd.append(guest)
    while len(herd) < population and len(herd[0].bins) > bound:
        mixed = sorted(order, key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
        herd.append(best_fit(sizes, mixed, Packing([], []), capacity))
    scored = sorted(((h.fitness(capacity), n, h) for n, h in enumerate(herd)), key=lambda x: x[:2], reverse=True)
    born = len(herd)
    for _ in range(generations):
        if -scored[0][0][0] <= bound or len(scored) < 2:
            break
        for _ in range(population // 2):
            one, other = rng.sample(scored, 2)
            child = crossover(sizes, one[2], other[2], capacity, rng)
            scored.append((child.fitness(capacity), born, child))
            born += 1
        scored = sorted(scored, key=lambda x: x[:2], reverse=True)[:population]
    return scored[0][2]


def _assigned(packing: Packing, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, members in enumerate(packing.bins):
        out[members] = b
    return out


def _packing(assigned: np.ndarray, sizes: list[int]) -> Packing:
    n = int(assigned.max()) + 1 if len(assigned) else 0
    bins: list[list[int]] = [[] for _ in range(n)]
    for i, b in enumerate(assigned.tolist()):
        bins[b].append(i)
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


@dataclass(frozen=True)
class Evolution:
    """How islands of a level evolve: individuals of each, generations of an epoch, epochs."""

    population: int = 4
    generations: int = 4
    epochs: int = 2
    islands: int = 2


#: The first level has nearly all pieces; later ones are small and get more generations.
FIRST, LATER = Evolution(), Evolution(6, 10)
#: Levels at most. Each packs what sequences that aren't full hold at the level before.
LEVELS = 4
ELITE = "block long, island int, bins int, fill double, assigned array<int>"


def _elites(lengths: DataFrame, capacity: int, how: Evolution, seed: int) -> DataFrame:
    """``(block, assigned)``: the best packing that the islands of each block of ``(block, uid, length)`` have found."""
    spread = lengths.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(how.islands)])))

    def grow(epoch: int, key, items: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"block": [], "island": [], "bins": [], "fill": [], "assigned": []})
        items = items.sort_values(["length", "uid"], ascending=[False, True])
        sizes = items["length"].tolist()
        guest = _packing(np.asarray(guests["assigned"].iloc[0]), sizes) if len(guests) else None
        best = evolve(sizes, capacity, hash((seed, int(key[0]), int(key[1]), epoch)), guest, how.population, how.generations)
        bins, fill = best.fitness(capacity)
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins": [-bins], "fill": [fill], "assigned": [_assigned(best, len(sizes))]})

    def in_epoch(epoch: int):
        return lambda key, items, guests: grow(epoch, key, items, guests)

    elites = durable(spread.groupBy("block", "island").applyInPandas(lambda key, items: grow(0, key, items, items.iloc[:0]), ELITE))
    for epoch in range(1, how.epochs):
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(how.islands)).cast("int"))
        elites = durable(spread.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(in_epoch(epoch), ELITE))
    return elites.groupBy("block").agg(F.max_by("assigned", F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("assigned"))


def _placing(level: int, last: bool, capacity: int):
    """Sequence and offset of each piece of a block, and whether its sequence stays as it is."""

    def place(key, items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "uid"], ascending=[False, True])
        assigned = np.asarray(chosen["assigned"].iloc[0]) if len(items) else np.zeros(0, int)
        # 3 bits for the level, 36 for the block and 24 for the sequence in it
        items["sequence_id"] = (level << 60) + (int(key[0]) << 24) + assigned.astype(np.int64)
        bins = items.groupby("sequence_id")["length"]
        items["offset"] = bins.cumsum() - items["length"]
        items["stays"] = last | (bins.transform("sum") == capacity)
        return items[["uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "stays"]]

    return place


def pack(
    docs: DataFrame, spec: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    block_items: int = 2048, first: Evolution = FIRST, later: Evolution = LATER, levels: int = LEVELS, seed: int = 7,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns ``(id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece. A document's ids are followed by ``end_id``, so that null and empty texts take one token. Only longer documents are cut; all pieces but the first have ``capacity`` ids, however long the text. Full pieces are sequences of their own. Pieces of one length, and repeated rows, are told apart by a number of their own and packed like others; an empty table gives no rows; other columns don't matter.

    Blocks hold about ``block_items`` pieces each, whatever the number or likeness of the documents, because rows are dealt by a number that no two share. After ``levels`` levels, or once there is but one block, all sequences stay as they are.
    """
    all_pieces = durable(pieces(docs, spec, end_id, capacity, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    full = all_pieces.where(F.col("length") == capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [full.withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")}).select(*columns)]
    left = all_pieces.where(F.col("length") < capacity)
    for level in range(levels):
        n_blocks = max(1, -(-left.count() // block_items))
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "uid"), F.lit(n_blocks)))
        best = _elites(dealt.select("block", "uid", "length"), capacity, later if level else first, seed + level)
        last = n_blocks == 1 or level == levels - 1

        out = f"{PIECES.format(kind)}, sequence_id long, offset long, stays boolean"
        placed = durable(dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_placing(level, last, capacity), out))
        done.append(placed.where("stays").select(*columns))
        if last:
            break
        left = placed.where("NOT stays").select("uid", *columns[:5])
    packed = reduce(DataFrame.unionByName, done)
    return packed if id_col == "doc_id" else packed.withColumnRenamed("doc_id", id_col)
