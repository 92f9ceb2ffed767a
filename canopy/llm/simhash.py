"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one padded with zeros to 23). The binary Golay code of length 23 is perfect: a word within one bit of both of two words is within three bits of exactly one codeword, so two segments at most two bits apart share a codeword within four bits; a word has one or six such codewords. Of three segments with two errors at most, one is free of them. Keys therefore pair a segment as it is with a codeword near the next segment: two fingerprints within two bits share a key, and a key has 33 bits or more. Key groups of few fingerprints are compared; fingerprints of larger groups meet instead at the 64 words one bit away and at themselves, where two meet only if they are within two bits, and no more than 65 can.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.text import SPACE_WORDS, by_block, split_words, then_give_back

#: Generator polynomial of the Golay code of length 23, fixed: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a key group that are compared in pairs; larger groups go by one-bit neighbours.
PAIRED = 32
#: Edges whose components one task finds; more go by rounds of joins. Each round plans a dozen exchanges, whose threads and buffers the driver keeps for a minute.
ONE_TASK_EDGES = 1 << 19


def shingle_hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the texts, and the n + 1 offsets of the texts among them."""
    words = split_words(text, SPACE_WORDS, lower=True)
    size = words.end - words.start
    # Words again, each followed by one space
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = SPACE_WORDS[words.data]
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[inside]
    n_words = np.diff(words.first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    lead = words.first[row] + np.arange(len(row)) - first[row]
    last = np.minimum(lead + shingle, words.first[row + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], 42) for a, b in zip(begin[lead].tolist(), (begin[last] + size[last]).tolist(), strict=True)], np.uint64), first


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: a bit is 1 if it is set in over half the XXH64 (seed 42) of the text's shingles.

    A-Z are lower-cased, words are runs free of white space, shingles are joined by one space; fewer words form one shingle, none give 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, text = batch.columns
        hashes, first = shingle_hashes(text, shingle)
        n = np.diff(first)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        some = n > 0
        ones = np.zeros((len(n), 64), np.int64)
        if len(bits):
            ones[some] = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int32)
        value = np.packbits(ones * 2 > n[:, None], axis=1).view(">i8").reshape(-1).astype(np.int64)
        return pa.record_batch([ids, pa.array(value)], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(by_block("text", work, 1 << 20), f"id {kind}, fingerprint long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; per syndrome the errors of weight up to 4 that have it, and how many."""
    parity = np.zeros(1 << 12, np.int64)
    for m in range(1 << 12):
        rest = m << 11
        for shift in range(22, 10, -1):
            if rest >> shift & 1:
                rest ^= GENERATOR << (shift - 11)
        parity[m] = rest
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            errors[(parity[e >> 11] ^ e) & 0x7FF].append(e)
    table = np.full((1 << 11, 6), -1, np.int64)
    for s, found in enumerate(errors):
        table[s, : len(found)] = found
    return parity, table, np.array([len(f) for f in errors])


def near_codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages of all codewords within four bits of each 23-bit segment: rows and messages."""
    parity, errors, _ = golay()
    syndrome = (parity[segment >> 11] ^ segment) & 0x7FF
    words = np.where(errors[syndrome] >= 0, segment[:, None] ^ errors[syndrome], -1)
    row, k = np.nonzero(words >= 0)
    return row, words[row, k] >> 11


def keys(values: DataFrame) -> DataFrame:
    """``(fingerprint, key)`` for distinct fingerprints."""

    def run(batches):
        for batch in batches:
            v = batch.column(0).to_numpy().astype(np.uint64)
            parts = [((v >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i in range(3):
                row, message = near_codewords(parts[(i + 1) % 3])
                key = (i << 60) | (parts[i][row] << 12) | message
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(key)], names=["fingerprint", "key"])

    return values.mapInArrow(then_give_back(run), "fingerprint long, key long")


def links(values: DataFrame, bits: int = 2) -> DataFrame:
    """``(a, b)``, a < b: fingerprints within ``bits`` (2 at most) of each other, enough of them to connect all that are."""
    assert 0 <= bits <= 2
    keyed = durable(keys(values))
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keyed.join(crowd, "key"))
    groups = met.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list("fingerprint").alias("v"))
    pairs = groups.select(
        F.explode(
            F.flatten(
                F.transform(
                    "v",
                    lambda a: F.transform(
                        F.filter("v", lambda b: (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= bits)), lambda b: F.struct(a.alias("a"), b.alias("b"))
                    ),
                )
            )
        ).alias("p")
    ).select("p.a", "p.b")
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowded = met.where(F.col("n") > PAIRED).select("fingerprint").distinct()
    spots = crowded.select("fingerprint", F.explode(F.transform(masks, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("spot"))
    stars = spots.groupBy("spot").agg(F.collect_list("fingerprint").alias("v")).where(F.size("v") > 1)  # 65 at most
    stars = stars.select(F.array_min("v").alias("a"), F.explode("v").alias("b")).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
    return pairs.unionByName(stars).distinct()


def stars(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges ``(n, 2)`` that aren't the least of their component, and the least."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, root)`` for the nodes of edges ``(a, b)`` other than roots: the root is the least node of the component.

    One task joins up to ``one_task`` edges. Beyond, large and small stars alternate: in each round, neighbours of a node link to the least of them, until nothing changes. Edges stay in tables; links of a node with many are aggregated before they are moved.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    if edges.count() <= one_task:

        def run(batches):
            pairs = [np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches]
            if pairs:
                yield pa.record_batch([pa.array(x) for x in stars(np.concatenate(pairs))], names=["node", "root"])

        return durable(edges.coalesce(1).mapInArrow(then_give_back(run), "node long, root long"))
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of each document: 16 hex digits, and the least id that links of at most ``bits`` differing bits reach.

    Null and wordless texts have fingerprint 0, which links like others. Repeated rows and equal texts share a fingerprint and count once in all but the last join. A component of null ids only has a null one. An empty table gives no rows; other columns don't matter.
    """
    prints = durable(fingerprints(docs, shingle, id_col, text_col))
    values = durable(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    found = components(links(values.select("fingerprint"), bits))
    rooted = values.join(found, values["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
