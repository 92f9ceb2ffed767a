"""The estimator: data to neighbour graph to spanning forest to places, and new points later."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.encode import band_count, minhash
from canopy.functions.scalars import quantile
from canopy.operators import tree as trees
from canopy.operators.ann import approximate_knn
from canopy.operators.graph import degree_root, edges_from_graph
from canopy.operators.knn import exact_knn, jaccard_knn, knn_from_matrix, ranked
from canopy.operators.layout import LayoutConfig, layout_from_edges
from canopy.operators.lsh import SignatureIndex
from canopy.schema import METRICS, InputKind, check, kind_of
from canopy.storage import stored

SEARCHES = ("exact", "index")


class NotFitted(RuntimeError):
    """An attribute was asked for before ``fit``."""


class TreeMap:
    """M1-M7. Inputs are ``(id, on)``, ``(id, tokens)``, ``(id, v)`` or ``(i, j, d)``.

    search: ``exact`` neighbours, or those that an ``index`` finds at any size: signatures and bands for sets, which miss most neighbours that aren't near copies (see the README), cells for vectors.
    """

    def __init__(self, n_neighbors: int = 20, metric: str = "jaccard", n_permutations: int = 512, kc: int = 50, seed: int = 42, minhash_seed: int = 42, layout_iterations: int = 1000, layout_config: LayoutConfig | None = None, search: str = "exact") -> None:
        metric = metric.lower()
        if metric not in METRICS:
            raise ValueError(f"metric is one of {', '.join(METRICS)}")
        if search not in SEARCHES:
            raise ValueError(f"search is one of {', '.join(SEARCHES)}")
        if min(n_neighbors, n_permutations, kc) < 1:
            raise ValueError("n_neighbors, n_permutations and kc must be positive")
        self.options = {"n_neighbors": n_neighbors, "metric": metric, "n_permutations": n_permutations, "kc": kc, "seed": seed, "minhash_seed": minhash_seed, "layout_iterations": layout_iterations, "search": search}
        self.layout_config = layout_config or LayoutConfig(k=n_neighbors, kc=kc, fme_iterations=layout_iterations, seed=seed)
        self._clear()

    def _clear(self) -> None:
        self.kind: InputKind | None = None
        self.n = 0
        self._data = self._index = self._graph = self._tree = self._embedding = None

    def _get(self, name: str):
        value = getattr(self, name)
        if value is None:
            raise NotFitted(f"{name.strip('_')} isn't there before fit, or not for this metric")
        return value

    @property
    def embedding_(self) -> DataFrame:
        return self._get("_embedding")

    @property
    def tree_(self) -> DataFrame:
        return self._get("_tree")

    @property
    def graph_(self) -> DataFrame:
        return self._get("_graph")

    @property
    def index_(self) -> SignatureIndex:
        return self._get("_index")

    def fit(self, data: DataFrame | None = None, knn_graph: DataFrame | None = None) -> TreeMap:
        """M1: from data or from a kNN graph ``(i, rank, j, d)``, one of them."""
        if (data is None) == (knn_graph is None):
            raise ValueError("give data or knn_graph, one of them")
        self._clear()
        k, metric = self.options["n_neighbors"], self.options["metric"]
        if knn_graph is not None:
            self._graph = stored(knn_graph.select("i", "rank", "j", "d"))
            nodes = self._graph.select(F.explode(F.array("i", "j")).alias("node")).where("node >= 0").distinct()
        else:
            self.kind = kind_of(data)
            wanted = {"jaccard": (InputKind.SETS, InputKind.STRINGS), "precomputed": (InputKind.MATRIX,)}.get(metric, (InputKind.DENSE,))
            if self.kind not in wanted:
                raise TypeError(f"metric {metric} takes {' or '.join(w.value for w in wanted)}, not {self.kind.value}")
            if self.kind is InputKind.MATRIX:
                self._graph = stored(knn_from_matrix(data, k))
                nodes = data.select(F.col("i").alias("node")).distinct()
            else:
                self.n = check(data, self.kind)
                if self.n < 2 or k >= self.n:
                    raise ValueError(f"n_neighbors must be less than the {self.n} rows, of which there must be two")
                self._data = stored(data.select(F.col(data.columns[0]).cast("long").alias("id"), F.col(data.columns[1]).alias(data.columns[1])))
                nodes = self._data.select(F.col("id").alias("node"))
                self._graph = stored(self._neighbours())
        if self._graph.isEmpty():
            raise ValueError("no row has a neighbour")
        embedding, tree = layout_from_edges(nodes, edges_from_graph(self._graph), self.layout_config)
        self._embedding, self._tree = stored(embedding), tree
        self.n = self.n or nodes.count()
        return self

    def _approximate(self) -> bool:
        return self.options["search"] == "index"

    def _sign(self, sets: DataFrame) -> DataFrame:
        return minhash(sets, self.options["n_permutations"], self.options["minhash_seed"])

    def _neighbours(self) -> DataFrame:
        k, metric = self.options["n_neighbors"], self.options["metric"]
        if metric != "jaccard":
            return (approximate_knn if self._approximate() else exact_knn)(self._data, k, metric)
        if not self._approximate():
            return jaccard_knn(self._data, k)
        d = self.options["n_permutations"]
        self._index = SignatureIndex(d, band_count(d, self.n)).add(self._sign(self._data)).build()
        return self._index.knn_graph(k, self.options["kc"])

    def fit_transform(self, data: DataFrame | None = None, knn_graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """M2: places ``(id, x, y)`` and tree edges."""
        self.fit(data, knn_graph)
        return self.embedding_, self.tree_

    def kneighbors(self, points: DataFrame) -> DataFrame:
        """Neighbours among the fitted rows; the model stays as it is. For precomputed distances, ``(i, j, d)`` from new to fitted rows."""
        self._get("_graph")
        k, metric = self.options["n_neighbors"], self.options["metric"]
        if metric == "precomputed":
            return ranked(points.select("i", "j", "d"), k)
        if self._data is None:
            raise NotFitted("a model fitted on a graph has no data to compare with")
        if kind_of(points) is not self.kind:
            raise TypeError(f"the model was fitted on {self.kind.value}")
        if metric != "jaccard":
            check(points, self.kind, self._data.select(F.size(self._data.columns[1])).first()[0])
            return (approximate_knn if self._approximate() else exact_knn)(self._data, min(k, self.n), metric, points)
        if self._approximate():
            return self.index_.query(self._sign(points), k, self.options["kc"])
        return jaccard_knn(self._data, k, points)

    def transform(self, points: DataFrame) -> DataFrame:
        """M3: places of new points; nothing of the model changes."""
        return self.position(self._ids(points), self.kneighbors(points))

    @staticmethod
    def _ids(points: DataFrame) -> DataFrame:
        return points.select(F.col(points.columns[0]).cast("long").alias("id")).distinct()

    def position(self, ids: DataFrame, found: DataFrame, jitter: float = 0.001) -> DataFrame:
        """M5: beside the nearest neighbour, moved by 0.3 of the local scale towards the mean of neighbours 2 to 5.

        The scale is the median distance in the plane from fitted rows to their first neighbours, 1 if that is 0. A point without neighbours goes to the mean of all. The jitter comes from a seeded hash of the id, times the plane's range.
        """
        e = self.embedding_
        near = found.where("rank <= 5").join(e.withColumnRenamed("id", "j"), "j")
        first = near.where("rank = 1").select(F.col("i").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
        others = near.where("rank > 1").groupBy(F.col("i").alias("id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        a, b = (e.select(F.col("id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in ("i", "j"))
        pairs = self.graph_.where("rank = 1").select("i", "j").join(a, "i").join(b, "j")
        scale = quantile(pairs.select(F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")).alias("d")), "d", 0.5)
        whole = e.agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("range"))
        rows = ids.join(first, "id", "left").join(others, "id", "left").crossJoin(F.broadcast(whole))
        seed = F.lit(self.options["seed"])

        def uniform(salt: int):
            return (F.pmod(F.xxhash64(seed, F.lit(salt), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

        turn = 2 * 3.141592653589793 * uniform(3)
        norm = F.hypot(F.col("mx") - F.col("px"), F.col("my") - F.col("py"))
        step = 0.3 * F.lit(scale or 1.0)
        radius, angle = F.sqrt(-2 * F.log(uniform(1))), 2 * 3.141592653589793 * uniform(2)
        shake = jitter * F.col("range")

        def moved(p: str, m: str, a: str, swing) -> Column:
            towards = F.when(F.col(m).isNull(), 0.0).when(norm > 1e-8, (F.col(m) - F.col(p)) / norm).otherwise(swing(turn))
            return F.coalesce(F.col(p) + step * towards, F.col(a)) + shake * radius * swing(angle)

        return rows.select("id", moved("px", "mx", "ax", F.cos).alias("x"), moved("py", "my", "ay", F.sin).alias("y"))

    def add_points(self, points: DataFrame) -> DataFrame:
        """M4, M6: places of new points, which join data, graph, tree and embedding. Earlier places stay; points of one call don't see each other. A point without neighbours hangs on the least node, at 1.0."""
        found = stored(self.kneighbors(points))
        ids = stored(self._ids(points))
        if not ids.join(self.embedding_, "id", "left_semi").isEmpty():
            raise ValueError("ids of new points must be new")
        places = stored(self.position(ids, found))
        least = self.embedding_.agg(F.min("id")).first()[0]
        first = found.where("rank = 1").select(F.col("i").alias("id"), F.col("j"), F.col("d"))
        hung = ids.join(first, "id", "left").select(F.coalesce("j", F.lit(least)).alias("a"), F.col("id").alias("b"), F.coalesce("d", F.lit(1.0)).alias("w"))
        self._tree = stored(self._tree.unionByName(hung.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")))
        self._graph = stored(self._graph.unionByName(found))
        self._embedding = stored(self._embedding.unionByName(places))
        if self._data is not None:
            name = self._data.columns[1]
            self._data = stored(self._data.unionByName(points.select(F.col(points.columns[0]).cast("long").alias("id"), F.col(points.columns[1]).cast(self._data.schema[name].dataType).alias(name))))
        if self._index is not None:
            self._index.add(self._sign(points)).build()
        self.n += ids.count()
        return places

    def rooted(self) -> DataFrame:
        """The forest, rooted at the node of greatest degree."""
        root = degree_root(self.tree_).first()["node"]
        return trees.rooted(self.tree_, self.embedding_.select("id"), root)

    def path(self, a: int, b: int) -> DataFrame:
        """G22."""
        return trees.path(stored(self.rooted()), a, b)

    def distance(self, a: int, b: int) -> float:
        """G22."""
        return trees.distance(stored(self.rooted()), a, b)

    def distances_from(self, source: int) -> DataFrame:
        """Pseudotime."""
        return trees.distances_from(self.tree_, source, self.embedding_.select("id"))

    def save(self, path: str) -> None:
        """K1: a folder of Parquet and JSON."""
        spark = self.embedding_.sparkSession
        parts = {"embedding": self._embedding, "tree": self._tree, "graph": self._graph, "data": self._data}
        for name, df in parts.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        if self._index is not None:
            self._index.save(f"{path}/index")
        meta = {"options": self.options, "layout": asdict(self.layout_config), "kind": self.kind and self.kind.value, "n": self.n, "data": self._data is not None, "index": self._index is not None}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> TreeMap:
        """S15."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        out = cls(**meta["options"], layout_config=LayoutConfig(**meta["layout"]))
        out.kind, out.n = meta["kind"] and InputKind(meta["kind"]), meta["n"]
        out._embedding, out._tree, out._graph = (spark.read.parquet(f"{path}/{n}") for n in ("embedding", "tree", "graph"))
        out._data = spark.read.parquet(f"{path}/data") if meta["data"] else None
        out._index = SignatureIndex.load(spark, f"{path}/index") if meta["index"] else None
        return out

    def to_viz(self, title: str = "Tree map", include_edges: bool = True):
        """K7: a page builder with places and edges set."""
        from canopy.export.viz import TreeMapViz

        viz = TreeMapViz(title=title).set_points(self.embedding_)
        return viz.set_edges(self.tree_) if include_edges else viz

    def to_html(self, path: str, title: str = "Tree map", include_edges: bool = True) -> str:
        return self.to_viz(title, include_edges).write_html(path)

    def serve(self, port: int = 8050, open_browser: bool = True):
        return self.to_viz().serve(port, open_browser)

    def plot_static(self, path: str, **options) -> str:
        """K11."""
        return self.to_viz().write_svg(path, **options)


__all__ = ["NotFitted", "TreeMap"]
