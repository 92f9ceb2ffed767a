"""Byte-level BPE encoding with a queue of merge ranks on hierarchical bitmaps, and decoding.

A piece of text is a linked list of tokens, at first its bytes. Each pair of neighbours whose bytes together are a token waits in the bucket of that token's rank, by the position of its left one. A bitmap has a bit for each rank whose bucket isn't empty, a second one a bit for each 64 bits of the first, and so on up to one word: the lowest waiting rank is found by one find-first-set a level, and waiting and leaving take as many steps. A merge changes two pairs, which wait anew under their new ranks; what waits under the old ones is stale and skipped when it is met. So a piece of n bytes takes time in proportion to n, whatever its ranks, where searching for the lowest pair each time takes n for each merge.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush, merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from canopy.llm.text import by_block, segments, slices, text_bytes
from canopy.llm.transducer import split_texts

#: Bytes of pieces and their ids that a worker keeps for later blocks.
KNOWN_BYTES = 64 << 20
#: Pieces of up to so many bytes are merged together; longer ones one by one, in time proportional to their length.
BATCHED = 64


class RankBits:
    """Which ranks have entries waiting: bitmaps over bitmaps, 64 bits of one to a bit of the next."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = -(-max(ranks, 1) // 64)
            self.levels.append([0] * ranks)

    def set(self, rank: int) -> None:
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            word = level[at]
            level[at] = word | 1 << bit
            if word:
                break

    def clear(self, rank: int) -> None:
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                break

    def first(self) -> int:
        """The lowest rank set, -1 if none is."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << 6 | ((word & -word).bit_length() - 1)
        return at


class RankQueue:
    """Buckets of positions by rank: what the queue was filled with, in one array in order of ranks and positions, and what was pushed later."""

    def __init__(self, ranks: int) -> None:
        self.bits = RankBits(ranks)
        self.given, self.cursor = np.zeros(0, np.int32), {}
        self.later: dict[int, list[int]] = {}

    def fill(self, rank: np.ndarray, position: np.ndarray) -> None:
        """Take many entries at once into an empty queue; positions rise."""
        order = np.argsort(rank, kind="stable")
        self.given = position[order].astype(np.int32)
        values, first = np.unique(rank[order], return_index=True)
        for r, low, high in zip(values.tolist(), first.tolist(), np.append(first[1:], len(order)).tolist(), strict=len(order) > 0):
            self.cursor[r] = (low, high)
            self.bits.set(r)

    def push(self, rank: int, position: int) -> None:
        """Add to a bucket, which stays a heap."""
        heap = self.later.get(rank)
        if heap is None:
            self.later[rank] = [position]
            self.bits.set(rank)
        else:
            heappush(heap, position)

    def take(self, rank: int) -> np.ndarray:
        """All positions of a bucket, which is empty then."""
        low, high = self.cursor.pop(rank, (0, 0))
        self.bits.clear(rank)
        late = self.later.pop(rank, None)
        return self.given[low:high] if late is None else np.concatenate((self.given[low:high], np.array(late, np.int32)))

    def pop(self, rank: int) -> int:
        """The first position of a bucket."""
        if rank in self.cursor:
            # What was given goes to the heap when its rank comes first
            low, high = self.cursor.pop(rank)
            own = self.given[low:high].tolist()
            heap = self.later.get(rank)
            self.later[rank] = own if heap is None else list(merge(own, sorted(heap)))
        heap = self.later[rank]
        position = heappop(heap)
        if not heap:
            del self.later[rank]
            self.bits.clear(rank)
        return position


class Encoder:
    """Ids of pieces by the ranks of tokens; a rank is its token's id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for byte {missing[0]}")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # All pairs of tokens whose bytes together are a token
        self.pairs = {a << 32 | b: r for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.joint = np.array([self.pairs[k] for k in self.keys.tolist()] or [-1], np.int32)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        if not len(self.keys):
            return np.full(len(key), -1, np.int32)
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.joint[spot], -1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of a piece: of all pairs the one of lowest rank, and of these the first, is merged, until no pair is a token."""
        n, queue, pair = len(piece), self.queue, self.pairs.get
        tokens = self.single[np.frombuffer(piece, np.uint8)]
        rank = np.append(self.pair(tokens[:-1], tokens[1:]), -1).astype(np.int32)
        spots = np.flatnonzero(rank >= 0)
        queue.fill(rank[spots], spots)
        token, joined = array("i", tokens.tobytes()), array("i", rank.tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        while (r := queue.bits.first()) >= 0:
            at = queue.pop(r)
            if joined[at] != r:
                continue  # stale: one of the pair was merged with another
            right = after[at]
            beyond = after[right]
            token[at], after[at] = r, beyond
            joined[right] = joined[at] = -1
            if beyond < n:
                before[beyond] = at
                q = joined[at] = pair(r << 32 | token[beyond], -1)
                if q >= 0:
                    queue.push(q, at)
            left = before[at]
            if left >= 0:
                q = joined[left] = pair(token[left] << 32 | r, -1)
                if q >= 0:
                    queue.push(q, left)
        out, at = array("i"), 0
        while at < n:
            out.append(token[at])
            at = after[at]
        return np.frombuffer(out, np.int32)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, joined, and how many each has.

        Lists of all pieces wait in one queue, which pieces can share since none changes another. Of the lowest rank's bucket each piece merges its first pair, all of them at once; further pairs of a piece wait, as a merge may bring a lower rank before them.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, owner = len(raw), np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        token = np.append(self.single[raw], -1).astype(np.int64)  # place n stands beyond either end
        after, before = np.append(np.arange(1, n + 1), n).astype(np.int32), np.append(np.arange(-1, n - 1), n).astype(np.int32)
        after[last], before[last - size + 1] = n, n
        joined = np.append(self.pair(token[:-1], token[after[:-1]]), -1).astype(np.int32)
        alive = np.ones(n, bool)
        spots = np.flatnonzero(joined >= 0)
        queue = self.queue
        queue.fill(joined[spots], spots)
        while (r := queue.bits.first()) >= 0:
            at = queue.take(r)
            at = at[joined[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                own = owner[at]
                later = own[1:] == own[:-1]
                if later.any():
                    queue.later[r] = at[1:][later].tolist()
                    queue.bits.set(r)
                    at = at[np.append(True, ~later)]
            right = after[at]
            beyond, left = after[right], before[at]
            token[at], after[at], before[beyond] = r, beyond, at
            joined[right], alive[right] = -1, False
            spots = np.concatenate((left, at))
            q = self.pair(token[spots], np.concatenate((token[at], token[beyond])))
            joined[spots] = q
            some = q >= 0
            for rank, place in zip(q[some].tolist(), spots[some].tolist(), strict=True):
                queue.push(rank, place)
        return token[:-1][alive].astype(np.int32), np.bincount(owner[alive], minlength=len(pieces))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers. A piece that is a token is that token, as the library has it."""
        out, new = [self.known.get(p) for p in pieces], []
        for i, (p, ids) in enumerate(zip(pieces, out, strict=True)):
            if ids is not None:
                continue
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > BATCHED:
                out[i] = self.merge_long(p).astype("<u4").tobytes()
            else:
                new.append(i)
        if new:
            ids, count = self.merge_many([pieces[i] for i in new])
            raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
            for i, a, b in zip(new, [0, *ends], ends, strict=False):
                out[i] = raw[a:b]
                self.held += len(pieces[i]) + b - a + 150
                self.known[pieces[i]] = out[i]
            if self.held > KNOWN_BYTES:
                self.known, self.held = {}, 0
        return out


def read_ranks(spec: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines()) if token}


@lru_cache(maxsize=1)
def encoder(spec: bytes) -> Encoder:
    """One a process; what it knows stays for the next batches."""
    return Encoder(read_ranks(spec))


@lru_cache(maxsize=1)
def tokens(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in order of ids, and the bounds of each; an id without a token has none."""
    ranks = read_ranks(spec)
    size = np.zeros(max(ranks.values()) + 2, np.int64)
    for token, r in ranks.items():
        size[r + 1] = len(token)
    return np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8), np.cumsum(size)


def encode(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` of each document; ``ids`` are little-endian unsigned 32-bit integers.

    spec: a rank file (a vocabulary of bounded size goes to the executors). Texts are split as ``public_tokenizers.PATTERN`` has it and each match is encoded by itself; strings of special tokens are text. Null and empty texts have no tokens; long texts and long matches are encoded whole; a row is returned for each row given, repeated or not; an empty table gives no rows; other columns don't matter. Pairs of equal rank are merged from the left. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(shared.value)
        ids, column = batch.columns
        pieces, first = split_texts(*text_bytes(column))
        coded = own.encode(pieces.dictionary.to_pylist())
        size = np.array([len(c) // 4 for c in coded], np.int64)
        begin = np.cumsum(size) - size
        index = pieces.indices.to_numpy(zero_copy_only=False)
        count = size[index]
        flat = np.frombuffer(b"".join(coded), "<u4")[np.repeat(begin[index], count) + segments(count)]
        bounds = np.concatenate(([0], np.cumsum(count)))[first]
        return pa.record_batch([ids, pa.array(np.diff(bounds)), slices(flat.view(np.uint8), bounds * 4).cast(pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_block("text", work), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, spec: bytes, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with ``name``: the bytes of the tokens in ``ids_col``, as ``encode`` gives them.

    Null and empty ids give no bytes. An id that no token has is an error, and so are bytes that are no whole ids. Bytes needn't be valid UTF-8, as ids may end within a character.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = tokens(shared.value)
        raw, offsets = text_bytes(batch.column(ids_col))
        if (offsets % 4).any():
            raise ValueError("ids are 32-bit integers")
        ids = np.ascontiguousarray(raw).view("<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(bounds) - 1 or (bounds[ids] == bounds[ids + 1]).any()):
            raise ValueError("an id has no token")
        size = bounds[ids + 1] - bounds[ids]
        out = data[np.repeat(bounds[ids], size) + segments(size)]
        ends = np.concatenate(([0], np.cumsum(size)))[offsets // 4]
        return batch.append_column(name, slices(out, ends).cast(pa.binary()))

    schema = StructType([*encoded.schema.fields, StructField(name, BinaryType())])
    return encoded.mapInArrow(by_block(ids_col, work, 1 << 20), schema)
