"""Nearest neighbours of signatures by banded hashing: equi-joins on (band, hash)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.encode import MASK, bands, signature_distance
from canopy.operators.dealt import SALTS, met
from canopy.operators.knn import BROADCAST_BYTES, ranked  # noqa: F401
from canopy.operators.overlap import overlapping
from canopy.storage import stored


class SignatureIndex:
    """Signatures ``(id, sig)`` and their bands. Signatures of empty sets are kept, but found only with ``keep_empty``: empty sets are no neighbours, of each other neither."""

    def __init__(self, d: int = 128, l: int | None = None, store: bool = True, keep_empty: bool = False) -> None:  # noqa: E741
        self.d, self.l = d, l if l is not None else max(1, d // 2)
        if not 0 < self.l <= d:
            raise ValueError(f"bands must be 1 to {d}")
        #: store=False keeps bands only: candidates can be asked for, distances can't.
        self.store, self.keep_empty = store, keep_empty
        self.sigs: DataFrame | None = None
        self.bands: DataFrame | None = None
        self.pending: list[DataFrame] = []
        #: Pairs that the last ``nearest`` compared, level by level.
        self.compared: list[int] = []

    def add(self, sigs: DataFrame) -> SignatureIndex:
        """More signatures; ``build`` makes them findable."""
        self.pending.append(sigs.select("id", "sig"))
        return self

    def build(self) -> SignatureIndex:
        """N4."""
        for new in self.pending:
            if self.store:  # written once, read for the bands and later for distances
                new = stored(new)
                self.sigs = new if self.sigs is None else self.sigs.unionByName(new)
            weighted = "struct" in dict(new.dtypes)["sig"]
            known = new if self.keep_empty or weighted else new.where(F.exists("sig", lambda x: x != MASK))
            made = bands(known, self.l)
            self.bands = made if self.bands is None else self.bands.unionByName(made)
        self.bands = stored(self.bands)
        self.pending = []
        return self

    @property
    def is_clean(self) -> bool:
        return not self.pending

    @property
    def is_indexed(self) -> bool:
        return self.bands is not None

    @property
    def size(self) -> int:
        return 0 if self.bands is None else (self.sigs if self.store else self.bands.select("id").distinct()).count()

    def clear(self) -> None:
        self.sigs = self.bands = None
        self.pending = []

    def signature(self, of: int) -> DataFrame:
        """N14."""
        return self._stored().where(F.col("id") == of)

    def _stored(self) -> DataFrame:
        if self.sigs is None:
            raise RuntimeError("no signatures are stored; build the index with store=True")
        return self.sigs

    def candidates(self, queries: DataFrame | None = None, budget: int = 50) -> DataFrame:
        """``(i, j, first_band)``: the first ``budget`` in order of the first shared band, then id. Without queries, each member asks, and takes a slot itself.

        Of a bucket only the ``budget`` least ids can be among the first ``budget`` of anything that shares it, so that a bucket of very many members meets itself that many times at most.
        """
        asked = self.bands.withColumnRenamed("id", "i") if queries is None else bands(queries, self.l).withColumnRenamed("id", "i")
        least = self.bands.withColumn("_r", F.row_number().over(Window.partitionBy("band", "h").orderBy("id"))).where(F.col("_r") <= budget).drop("_r")
        met = asked.join(least.withColumnRenamed("id", "j"), ["band", "h"])
        first = met.groupBy("i", "j").agg(F.min("band").alias("first_band"))
        w = Window.partitionBy("i").orderBy("first_band", "j")
        return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= budget).drop("r")

    def _distances(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        a = asked.select(F.col("id").alias("i"), F.col("sig").alias("a"))
        b = self._stored().select(F.col("id").alias("j"), F.col("sig").alias("b"))
        return pairs.join(a, "i").join(b, "j").select("i", "j", signature_distance(F.col("a"), F.col("b")).alias("d"))

    def knn_graph(self, k: int, kc: int = 10) -> DataFrame:
        """Candidates within ``k * kc``, without the row itself, ranked by signature distance."""
        pairs = self.candidates(budget=k * kc).where("i <> j").select("i", "j")
        return ranked(self._distances(pairs, self._stored()), k)

    def query(self, queries: DataFrame, k: int, kc: int = 10) -> DataFrame:
        """Neighbours of ``queries (id, sig)``; members of the same id aren't left out."""
        return ranked(self._distances(self.candidates(queries, k * kc).select("i", "j"), queries), k)

    def search(self, queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
        """Neighbours of the members in ``queries (id)`` by exact Jaccard distance of ``sets (id, set)``, of all members that share a band with them, however many; pairs without a common element are left out, as ``jaccard_knn`` does.

        No candidate is cut, so that recall depends on the bands alone: with bands of one value, a member at similarity s is missed with probability (1 - s)^bands. Bands and sets of the queries go to every executor by blocks of bounded size, and pairs are never written (see ``overlap``).
        """
        own = sets.select(F.col(sets.columns[0]).cast("long").alias("id"), F.array_distinct(sets.columns[1]).alias("s"))
        # A member's bands as one row of keys
        keys = self.bands.groupBy("id").agg(F.collect_list(F.xxhash64("band", "h")).alias("keys"))
        rows = stored(own.join(keys, "id"))
        asked = rows.join(queries.select("id").distinct(), "id", "left_semi")
        return overlapping(rows.withColumnRenamed("id", "j"), asked.withColumnRenamed("id", "i"), k, False)

    def _prefixes(self, sigs: DataFrame, depth: int) -> DataFrame:
        """``(id, tree, h)``: each band is a path from the root of a prefix tree; its first ``depth`` values name a node."""
        rows = self.d // self.l
        return sigs.select("id", F.explode(F.sequence(F.lit(0), F.lit(self.l - 1))).alias("tree"), "sig").select("id", "tree", F.xxhash64("tree", F.slice("sig", F.col("tree") * rows + 1, depth)).alias("h"))

    def _level(self, asked: DataFrame, members: DataFrame, depth: int) -> DataFrame:
        """``(i, j)`` once each that share a node at ``depth`` in some tree. Buckets are dealt to several tasks."""
        a = self._prefixes(asked, depth).withColumnRenamed("id", "i").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        b = self._prefixes(members, depth).withColumnRenamed("id", "j").withColumn("_s", F.pmod(F.xxhash64("j"), F.lit(SALTS)).cast("int"))
        return a.join(b, ["tree", "h", "_s"]).select("i", "j").distinct()

    def deepened(self, asked: DataFrame, members: DataFrame, found: Callable[[DataFrame], DataFrame], enough: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """For every row of ``asked (id, sig)`` what ``found`` makes of the pairs ``(i, j)`` with ``members (id, sig)`` that share a node of some tree, at the deepest level at which its ``i`` is in ``enough`` of that and the level; at the first level whatever is there."""
        out, left = None, asked.select("id", "sig")
        for depth in range(self.d // self.l, 0, -1):
            rows = stored(found(self._level(left, members, depth)))
            if depth == 1:
                return rows if out is None else out.unionByName(rows)
            done = stored(enough(rows, depth).select("i").distinct())
            settled = rows.join(done, "i", "left_semi")
            out = settled if out is None else out.unionByName(settled)
            left = stored(left.join(done.withColumnRenamed("i", "id"), "id", "left_anti"))
            if left.isEmpty():
                return out

    def nearest(self, queries: DataFrame, sets: DataFrame, k: int, miss: float = 0.05) -> DataFrame:
        """``(i, rank, j, d)``, neighbours of the members in ``queries (id)`` by exact Jaccard distance of ``sets (id, set)``, ties by j. Trees of prefixes are gone up for each query until a set as near as the k-th that it has found would have been missed with a probability of ``miss`` at most, (1 - s ** depth) ** trees at similarity s; so near neighbours cost few comparisons, and far ones are still found at the first level.

        Equal sets are one node: a text with very many copies is compared once, and its k least ids stand for it. Pairs without a common element, and empty sets, are left out; queries that aren't members have no rows; a member is a neighbour of itself.
        """
        sets = sets.select(F.col(sets.columns[0]).cast("long").alias("id"), F.array_distinct(sets.columns[1]).alias("s")).where(F.size("s") > 0)
        known = self._stored().dropDuplicates(["id"]).select("id", "sig")
        # Sets by their digest, so that only one of each goes on
        own = stored(sets.select("id", F.sha2(F.to_json(F.struct(F.array_sort("s").alias("s"))), 256).alias("c")).join(known.select("id"), "id", "left_semi"))
        first = stored(own.groupBy("c").agg(F.min("id").alias("id")))
        least = own.select("c", F.col("id").alias("j"), F.row_number().over(Window.partitionBy("c").orderBy("id")).alias("_r")).where(F.col("_r") <= k).groupBy("c").agg(F.collect_list("j").alias("js"))
        asked = stored(met(own.select("id", "c").join(queries.select("id").distinct(), "id", "left_semi"), first.select("c", F.col("id").alias("rep")), "c", ["id"]))
        signed = stored(sets.join(known.join(first.select("id"), "id", "left_semi"), "id").select("id", "s", "sig"))
        left = stored(signed.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
        out, self.compared = None, []
        for depth in range(self.d // self.l, 0, -1):
            # Nodes of all trees at this depth as one row of keys
            rows = self.d // self.l
            keys = F.transform(F.sequence(F.lit(0), F.lit(self.l - 1)), lambda t: F.xxhash64(t, F.slice("sig", t * rows + 1, depth)))  # noqa: B023
            level = stored(overlapping(signed.select(F.col("id").alias("j"), "s", keys.alias("keys")), left.select(F.col("id").alias("i"), "s", keys.alias("keys")), k, False, count=True))
            self.compared.append(level.where("rank = 0").agg(F.sum("j")).first()[0] or 0)
            found = level.where("rank > 0")
            if depth > 1:
                done = found.where(F.col("rank") == k).where(F.pow(1 - F.pow(1 - F.col("d"), F.lit(depth)), F.lit(self.l)) <= miss).select(F.col("i").alias("id"))
                done = stored(done)
                found = found.join(done.withColumnRenamed("id", "i"), "i", "left_semi")
                left = stored(left.join(done, "id", "left_anti"))
            out = found if out is None else out.unionByName(found)
            if left.isEmpty():
                break
        d = out.join(first.select(F.col("id").alias("j"), "c"), "j")
        # Of different sets the k nearest by (distance, least id) hold the k nearest members
        spread = met(d.select("i", "c", "d"), least, "c", ["i"]).select("i", F.explode("js").alias("j"), "d")
        lists = ranked(spread, k).groupBy("i").agg(F.collect_list(F.struct("rank", "j", "d")).alias("l")).withColumnRenamed("i", "rep")
        return met(asked, lists, "rep", ["id"]).select(F.col("id").alias("i"), F.explode("l").alias("e")).select("i", "e.rank", "e.j", "e.d")

    def query_by_id(self, of: int, k: int, kc: int = 10) -> DataFrame:
        """One neighbour more is asked for, and the row itself dropped."""
        found = self.candidates(self.signature(of), (k + 1) * kc).where("i <> j").select("i", "j")
        return ranked(self._distances(found, self.signature(of)), k)

    def linear_scan(self, query: DataFrame, subset: DataFrame, k: int = 10) -> DataFrame:
        """Exact signature distance to the members in ``subset (id)``."""
        pairs = query.select(F.col("id").alias("i")).crossJoin(subset.select(F.col("id").alias("j")))
        return ranked(self._distances(pairs, query), k)

    def all_distances(self, signature: list) -> DataFrame:
        """``(j, d)`` from one signature to every member."""
        one = F.array(*[F.lit(x) for x in signature])
        return self._stored().select(F.col("id").alias("j"), signature_distance(F.col("sig"), one).alias("d"))

    def distance_by_id(self, a: int, b: int) -> float:
        """N12."""
        x, y = (self.signature(n).select("sig") for n in (a, b))
        return x.withColumnRenamed("sig", "x").crossJoin(y.withColumnRenamed("sig", "y")).select(signature_distance(F.col("x"), F.col("y"))).first()[0]

    def neighbour_ids(self, k: int, kc: int = 10) -> DataFrame:
        """N11."""
        return self.knn_graph(k, kc).select("i", "rank", "j")

    def save(self, path: str) -> None:
        """K2: Parquet, bands by band; pending signatures are saved as pending."""
        spark = self.bands.sparkSession
        spark.createDataFrame([(self.d, self.l, self.store, self.keep_empty, len(self.pending))], "d int, l int, store boolean, keep_empty boolean, pending int").write.mode("overwrite").json(f"{path}/meta")
        self.bands.write.mode("overwrite").partitionBy("band").parquet(f"{path}/bands")
        if self.store:
            self.sigs.write.mode("overwrite").parquet(f"{path}/sigs")
        for i, p in enumerate(self.pending):
            p.write.mode("overwrite").parquet(f"{path}/pending{i}")

    @classmethod
    def load(cls, spark, path: str) -> SignatureIndex:
        """S14."""
        m = spark.read.schema("d int, l int, store boolean, keep_empty boolean, pending int").json(f"{path}/meta").first()
        out = cls(m["d"], m["l"], m["store"], m["keep_empty"])
        out.bands = spark.read.parquet(f"{path}/bands").select("id", "band", "h")
        out.sigs = spark.read.parquet(f"{path}/sigs") if m["store"] else None
        out.pending = [spark.read.parquet(f"{path}/pending{i}") for i in range(m["pending"])]
        return out
