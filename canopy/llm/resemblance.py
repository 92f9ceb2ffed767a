"""Near-duplicates by SimHash, and by Jaccard similarity of shingles for those beyond its reach.

SimHash fingerprints within two bits are joined, found by Golay keys (``simhash.near_duplicates``). Fingerprints of 64 bits differ in about ten at a Jaccard similarity of 0.8, so texts alike by that much are found besides: bands of MinHash values propose pairs, shingle sets decide. A component is what links of either kind reach. Golay keys that reach so far keep 12 bits and would put every document of a large corpus beside thousands. A band of six MinHash values is shared with probability s^6, one of 20 bands with 0.998 at 0.8. Texts with the same set count once. Texts that share bands, directly or through others, are met by one task, which compares those that share a band and aren't joined yet, if they are ``CROWD`` at most. Of larger groups, a member of each band leads in each round: the band's members that it isn't joined with are compared with it, in joins that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.simhash import components, near_duplicates, shingle_hashes
from canopy.llm.text import by_block

SHINGLE, ALIKE = 5, 0.8
BANDS, ROWS, SEED = 20, 6, 42
#: Texts of a group that one task compares, and rounds of leaders in larger ones, after which what is left is compared at once.
CROWD, ROUNDS = 5000, 12


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def signed(rows: DataFrame, shingle: int) -> DataFrame:
    """``(at, id, digest, bands)``: a digest of each text's shingle set, and a key for each band; empty sets have no bands."""
    masks, factors = permutations(BANDS * ROWS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, ids, text = batch.columns
        hashes, first = shingle_hashes(text, shingle)
        some = np.flatnonzero(np.diff(first))
        least = np.zeros((len(masks), len(some)), np.uint64)
        for p in range(len(masks) if len(some) else 0):
            least[p] = np.minimum.reduceat((hashes ^ masks[p]) * factors[p], first[:-1][some])
        digest = [xxhash.xxh3_128_digest(np.unique(hashes[a:b]).tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        raw = np.ascontiguousarray(least.reshape(BANDS, ROWS, -1).transpose(2, 0, 1))
        keys = [xxhash.xxh64_intdigest(raw[d, b].tobytes(), b) for d in range(len(some)) for b in range(BANDS)]
        bounds = np.concatenate(([0], np.cumsum(np.where(np.diff(first) > 0, BANDS, 0))))
        bands = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
        return pa.record_batch([at, ids, pa.array(digest, pa.binary()), bands], names=["at", "id", "digest", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("at", "id", "text").mapInArrow(by_block("text", work, 1 << 20), f"at long, id {kind}, digest binary, bands array<bigint>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``(at, s)``: sorted hashes of the shingles of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, text = batch.columns
        hashes, first = shingle_hashes(text, shingle)
        sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.record_batch([at, pa.array(sets, pa.list_(pa.int64()))], names=["at", "s"])

    return rows.select("at", "text").mapInArrow(by_block("text", work, 1 << 20), "at long, s array<bigint>")


def joined(sets: list[np.ndarray], bands: list[np.ndarray], alike: float) -> list[int]:
    """For each set the least index that links of at least ``alike`` reach; sets that share no band aren't compared."""
    parent = list(range(len(sets)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    # Earlier members of each band by component, so that a set in one already costs one look
    met: dict[int, dict[int, list[int]]] = {}
    for x, (s, keys) in enumerate(zip(sets, bands, strict=True)):
        unlike = set()
        for key in keys.tolist():
            groups: dict[int, list[int]] = {}
            for root, members in met.get(key, {}).items():
                groups.setdefault(find(root), []).extend(members)
            for root, members in groups.items():
                if find(root) == find(x):
                    continue
                for m in reversed(members):
                    if m in unlike:
                        continue
                    low, high = sorted((len(s), len(sets[m])))
                    common = len(np.intersect1d(s, sets[m], assume_unique=True)) if low >= alike * high - 1e-9 else 0
                    if common >= alike * (low + high - common) - 1e-9:
                        a, b = find(x), find(m)
                        parent[max(a, b)] = min(a, b)
                        break
                    unlike.add(m)
            groups.setdefault(x, []).append(x)
            met[key] = groups
    return [find(x) for x in range(len(sets))]


def by_leaders(members: DataFrame, sets: DataFrame, alike: float, rounds: int = ROUNDS) -> DataFrame:
    """``(at, head)`` for members ``(at, bands)`` with sets ``(at, s)``, as ``joined`` tells them, in rounds of joins.

    In each round, the smallest component of each band that has members which haven't led yet gives one, which is compared with the band's members of other components. A band is done with once at most one component has members that haven't led.
    """
    keyed = durable(members.select("at", F.explode("bands").alias("key")))
    own = durable(sets)

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [own.select(F.col("at").alias(x), F.col("s").alias(f"s{x}")) for x in ("a", "b")]
        met = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
        return durable(met.where(F.col("n") >= alike * (F.size("sa") + F.size("sb") - F.col("n")) - 1e-9).select("a", "b"))

    links, component, led = None, members.select("at", F.col("at").alias("c")), None
    for r in range(rounds + 1):
        now = durable(keyed.join(component, "at"))
        free = now if led is None else now.join(led, ["key", "at"], "left_anti")
        size = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
        first = free.groupBy("key", "c").agg(F.min(F.struct(F.xxhash64(F.lit(r), "at").alias("h"), "at")).alias("f"))
        each = first.join(size, ["key", "c"]).groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", F.col("f.h").alias("h"), F.col("f.at").alias("at"), "c")).alias("l"))
        leads = durable(each.where("m > 1").select("key", F.col("l.at").alias("a"), F.col("l.c").alias("ca")))
        if leads.isEmpty():
            break
        if r < rounds:
            pairs = now.join(leads, "key").where("c <> ca").select("a", F.col("at").alias("b"))
        else:
            left = now.join(leads.select("key"), "key", "left_semi")
            pairs = left.select("key", F.col("at").alias("a"), F.col("c").alias("ca")).join(left, "key").where("c <> ca AND a < at").select("a", F.col("at").alias("b"))
        found = verified(durable(pairs.distinct()))
        links = found if links is None else links.unionByName(found)
        root = components(links).select(F.col("node").alias("at"), F.col("root").alias("c"))
        component = durable(members.select("at").join(root, "at", "left").select("at", F.coalesce("c", "at").alias("c")))
        new = leads.select("key", F.col("a").alias("at"))
        led = durable(new if led is None else led.unionByName(new))
    return component.select("at", F.col("c").alias("head"))


def copies(rows: DataFrame, shingle: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """``(at)`` of rows ``(at, id, text)`` that aren't the first of their component, by (id, at).

    Links are those of fingerprints within two bits and of shingle sets alike by ``alike``. ``at`` tells rows apart. Null and wordless texts have the empty set, all the same one; texts of fewer words than a shingle have one shingle; long texts have all of theirs. Repeated rows and equal sets or fingerprints count once until the last joins; an empty table gives no rows.
    """
    prints = durable(signed(rows, shingle))
    crowd_limit = CROWD
    key = F.struct("id", "at")
    values = durable(prints.groupBy("digest").agg(F.min(key).alias("least"), F.min_by("bands", key).alias("bands")).withColumn("at", F.col("least.at")))
    keyed = values.select("at", F.explode("bands").alias("key"))
    crowd = keyed.groupBy("key").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = components(keyed.join(crowd, "key").where("at <> low").select(F.col("low").alias("a"), F.col("at").alias("b")))
    met = durable(met.unionByName(met.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "at"))
    crowds = durable(met.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd_limit).select("root"))
    large = met.join(crowds, "root", "left_semi")
    sets = shingle_sets(rows.join(met, "at", "left_semi"), shingle)
    work = met.join(crowds, "root", "left_anti").join(values.select("at", "bands"), "at").join(sets, "at")

    def link(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("at")
        at = t["at"].to_numpy()
        return pd.DataFrame({"at": at, "head": at[joined(t["s"].tolist(), t["bands"].tolist(), alike)]})

    heads = durable(work.groupBy("root").applyInPandas(link, "at long, head long"))
    if not crowds.isEmpty():
        members = durable(large.select("at").join(values.select("at", "bands"), "at"))
        heads = heads.unionByName(by_leaders(members, sets.join(members, "at", "left_semi"), alike))
    rooted = values.join(heads, "at", "left").select("digest", F.coalesce("head", "at").alias("head"))
    near = near_duplicates(rows, id_col="at").select("at", F.col("component_id").alias("near"))
    # A row belongs with its head and with the first row of its component of fingerprints; what either joins is one
    every = durable(prints.select("at", "id", "digest").join(rooted, "digest").join(near, "at").select("at", "id", "head", "near"))
    whole = components(every.where("head <> near").select(F.col("head").alias("a"), F.col("near").alias("b")))
    classed = every.join(whole.withColumnRenamed("node", "head"), "head", "left").select("at", "id", F.coalesce("root", "head").alias("class"))
    kept = classed.groupBy("class").agg(F.min(key).alias("first"))
    # By row: a class may be a large part of all rows
    return classed.select("at").join(kept.select("first.at"), "at", "left_anti")
