"""Signatures of sets and weighted vectors, and the bands that index them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A Mersenne prime and the mask of a signature's values.
PRIME = (1 << 61) - 1
MASK = (1 << 32) - 1


def permutations(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers from [1, p), all drawn before the offsets from [0, p)."""
    if num_perm < 1:
        raise ValueError("num_perm must be at least 1")
    rng = np.random.RandomState(seed)
    a = rng.randint(1, PRIME, size=num_perm, dtype=np.uint64)
    return a, rng.randint(0, PRIME, size=num_perm, dtype=np.uint64)


def signatures_of(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least hash per permutation and set; an empty set has all ``MASK``. Arithmetic wraps at 64 bits."""
    out = np.full((len(offsets) - 1, len(a)), MASK, np.uint64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        x = flat.astype(np.uint64)
        for p in range(len(a)):
            h = ((a[p] * x + b[p]) % np.uint64(PRIME)) & np.uint64(MASK)
            out[some, p] = np.minimum.reduceat(h, offsets[:-1][some])
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate(([0], np.cumsum(size)))


def minhash(sets: DataFrame, num_perm: int = 128, seed: int = 1) -> DataFrame:
    """``(id, sig ARRAY<LONG>)`` of ``(id, on ARRAY<integer>)`` or ``(id, tokens ARRAY<STRING>)``.

    Tokens are hashed by XXH64 of seed 0, 63 bits of it. Null and empty sets have the empty signature; negative members are an error.
    """
    a, b = permutations(num_perm, seed)
    strings = sets.schema.fields[1].dataType.elementType.simpleString() == "string"

    def run(batches):
        import xxhash

        for batch in batches:
            flat, offsets = _lists(batch.column(1))
            if strings:
                coded = flat.dictionary_encode()
                ids = np.array([xxhash.xxh64_intdigest(t or "") & ((1 << 63) - 1) for t in coded.dictionary.to_pylist()], np.int64)
                members = ids[coded.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, np.int64)
            else:
                members = flat.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(members) and members.min() < 0:
                    raise ValueError("members of sets must not be negative")
            sig = signatures_of(members, offsets, a, b).astype(np.int64)
            bound = pa.array(np.arange(len(sig) + 1) * num_perm, pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(bound, pa.array(sig.reshape(-1)))], names=["id", "sig"])

    kind = sets.schema.fields[0].dataType.simpleString()
    return sets.select(F.col(sets.columns[0]).alias("id"), F.col(sets.columns[1]).alias("x")).mapInArrow(run, f"id {kind}, sig array<bigint>")


#: Values of a block of weighted vectors.
WEIGHTED_VALUES = 1 << 20


def weighted_minhash(vectors: DataFrame, dim: int, num_perm: int = 128, seed: int = 1) -> DataFrame:
    """``(id, sig ARRAY<STRUCT<k, y>>)`` by improved consistent weighted sampling (Ioffe 2010). Weights must be positive."""
    rng = np.random.RandomState(seed)
    r, log_c = rng.gamma(2, 1, (num_perm, dim)), np.log(rng.gamma(2, 1, (num_perm, dim)))
    beta = rng.uniform(0, 1, (num_perm, dim))

    # Rows of a block, so that its values for all permutations stay small
    step = max(1, WEIGHTED_VALUES // (num_perm * max(dim, 1)))

    def run(batches):
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            if column.null_count or (column.value_lengths().to_numpy() != dim).any() or not (x > 0).all():
                raise ValueError(f"weighted vectors need {dim} positive weights")
            keys, levels = np.empty((n, num_perm), np.int64), np.empty((n, num_perm), np.int64)
            for at in range(0, n, step):
                t = np.floor(np.log(x.reshape(n, dim)[at : at + step, None]) / r + beta)
                k = (log_c - r * (t - beta) - r).argmin(axis=2)
                keys[at : at + step], levels[at : at + step] = k, np.take_along_axis(t, k[:, :, None], 2)[:, :, 0]
            flat = pa.StructArray.from_arrays([pa.array(keys.reshape(-1)), pa.array(levels.reshape(-1))], names=["k", "y"])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * num_perm, pa.int32()), flat)], names=["id", "sig"])

    kind = vectors.schema.fields[0].dataType.simpleString()
    return vectors.select(F.col(vectors.columns[0]).alias("id"), F.col(vectors.columns[1]).alias("x")).mapInArrow(run, f"id {kind}, sig array<struct<k:bigint,y:bigint>>")


def signature_distance(a: Column, b: Column) -> Column:
    """Share of positions that differ; elements may be numbers or (k, y) pairs, of which both must match."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    apart = F.lit(1.0) - same / F.size(a)
    return F.when(F.size(a) == F.size(b), apart).otherwise(F.raise_error(F.lit("signatures differ in length")).cast("double"))


def band_count(d: int, n: int) -> int:
    """Number of bands for n rows of d values: 4 values a band up to a million rows, wider ones beyond."""
    width = 4 if n <= 1_000_000 else max(4, 4 + round(math.log2(n / 1e6)))
    return min(max(8, d // width), d)


def bands(sigs: DataFrame, count: int) -> DataFrame:
    """``(id, band, h)``: each band's values, hashed. Of weighted signatures only ``k`` counts. Values beyond the last band are unused."""
    element = sigs.schema["sig"].dataType.elementType.simpleString()
    sig = F.transform("sig", lambda x: x["k"]) if element.startswith("struct") else F.col("sig")
    rows = sigs.select("id", sig.alias("s"))
    width = F.floor(F.size("s") / count).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(F.slice("s", i * width + 1, width)))
    return rows.select("id", F.posexplode(hashed).alias("band", "h"))
