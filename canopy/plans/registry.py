"""Registered queries of the engine over the driver's tables. ``oracles`` has the SQL that gives the same rows.

Results are made comparable: doubles rounded to 6 places, whole numbers as long.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import encode, proteins, scalars, sql
from canopy.operators import analysis, ann, cells, facets, graph, knn, layout, prefix, tree
from canopy.operators.graph_index import GraphIndex
from canopy.operators.lsh import SignatureIndex
from canopy.operators.pairs import PathIndex
from canopy.operators.vectors import VectorIndex
from canopy.plans.model import TreeMap
from canopy.plans.oracles import ORACLE_SQL
from canopy.sources import formats, readers
from canopy.storage import shared_dir, stored
from canopy.streaming.neighbours import LISTS, Cells, nearest_of, neighbour_stream

K = 5
PERMUTATIONS, BANDS, SEED = 32, 8, 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comparable(df: DataFrame) -> DataFrame:
    def of(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c.cast("double"), 6).alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        return c

    return df.select(*[of(f) for f in df.schema.fields])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


# Inputs


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("value"))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words of each document."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \n]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as whole numbers: 60 bits of their MD5."""
    number = F.transform("tokens", lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long"))
    return tokens(spark, sf_dir).select("id", number.alias("on"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.minhash(token_ids(spark, sf_dir), PERMUTATIONS, SEED)


def index(spark: SparkSession, sf_dir: str) -> SignatureIndex:
    return SignatureIndex(PERMUTATIONS, BANDS, keep_empty=True).add(signatures(spark, sf_dir)).build()


def neighbour_graph(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return knn.exact_knn(points(spark, sf_dir), k, "cosine")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(graph.spanning_forest(stored(graph.edges_from_graph(neighbour_graph(spark, sf_dir)))))


def rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    mst = forest(spark, sf_dir)
    return stored(tree.rooted(mst, points(spark, sf_dir).select("id"), graph.degree_root(mst).first()["node"]))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's label as its nearest neighbour has it."""
    lab = labels(spark, sf_dir)
    near = neighbour_graph(spark, sf_dir, 1).select(F.col("i").alias("id"), F.col("j"), (F.lit(1.0) - F.col("d")).alias("confidence"))
    return near.join(lab, "id").join(lab.select(F.col("id").alias("j"), F.col("label").alias("predicted")), "j").select("id", "label", "predicted", "confidence")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of texts that are residues, as sequences."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("seq"))


def external(df: DataFrame) -> DataFrame:
    """The stated set of queries: ids divisible by 20, against all rows."""
    return df.where("id % 20 = 0")


# Neighbours


@query
def knn_cosine(spark, sf_dir):
    return neighbour_graph(spark, sf_dir)


@query
def knn_l2(spark, sf_dir):
    return knn.exact_knn(points(spark, sf_dir), K, "euclidean")


@query
def knn_external(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.exact_knn(p, K, "cosine", external(p))


@query
def knn_from_matrix(spark, sf_dir):
    """The matrix is made in blocks of rows against blocks of rows: its entries are this query's input."""
    p = points(spark, sf_dir)
    blocks = -(-p.count() // 2000) or 1
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left, right = p.withColumn("a", own).withColumn("b", every), p.select(F.col("id").alias("j"), F.col("v").alias("w"), own.alias("b")).withColumn("a", every)

    def far(q: pa.Table, x: pa.Table) -> pa.Table:
        v, w = (np.array(t[c].combine_chunks().flatten()).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t, c in ((q, "v"), (x, "w")))
        d = np.zeros((len(v), len(w)))
        turned = np.ascontiguousarray(w.T)
        for at in range(0, len(v) if d.size else 0, 16):  # few rows at a time stay in the cache
            for c in range(v.shape[1]):
                off = v[at : at + 16, c, None] - turned[c]
                off *= off
                d[at : at + 16] += off
        return pa.table({"i": np.repeat(np.array(q["id"]), len(w)), "j": np.tile(np.array(x["j"]), len(v)), "d": np.sqrt(d).reshape(-1)})

    matrix = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(far, "i long, j long, d double")
    return knn.knn_from_matrix(matrix, K)


@query
def approximate_recall(spark, sf_dir):
    """Whether the index of cells finds nine of ten neighbours of the stated queries, or more."""
    p = points(spark, sf_dir)
    q = external(p)
    true = stored(knn.exact_knn(p, K, "cosine", q))
    n = knn.recall(true, ann.approximate_knn(p, K, "cosine", q), K)
    return n.select("n", (F.col("recall") >= 0.9).alias("enough"))


@query
def graph_search_recall(spark, sf_dir):
    """Whether best-first search on the stored graph finds nine of ten neighbours of the stated queries, or more, and descent nine of ten of all lists."""
    p = points(spark, sf_dir)
    q = external(p)
    index = GraphIndex("cosine").build(p)
    asked = knn.recall(stored(knn.exact_knn(p, K, "cosine", q)), index.search(q, K), K)
    lists = knn.recall(stored(knn.exact_knn(p, K, "cosine")), index.neighbours(K), K)
    found = asked.select("n", (F.col("recall") >= 0.9).alias("found"))
    return found.join(lists.select(F.col("n").alias("members"), (F.col("recall") >= 0.9).alias("listed")))


@query
def cell_index_recall(spark, sf_dir):
    """Stored cells of nine tenths of the vectors, to which the others are added: whether the stated queries find nine of ten neighbours, or more."""
    p = points(spark, sf_dir)
    q = external(p)
    index = VectorIndex("cosine", mode="cells").build_from_vectors(p.where("id % 10 <> 9"))
    keys = stored(index.add(p.where("id % 10 = 9")))
    named = index.query_batch(q, K).join(keys.select(F.col("key").alias("j"), F.col("id").alias("own")), "j", "left")
    found = named.select("i", "rank", F.coalesce("own", "j").alias("j"), "d")
    return knn.recall(stored(knn.exact_knn(p, K, "cosine", q)), found, K).select("n", (F.col("recall") >= 0.9).alias("enough"))


@query
def graph_search_nearest(spark, sf_dir):
    """The member that the graph finds nearest to each of the stated queries, which are members themselves."""
    p = points(spark, sf_dir)
    return GraphIndex("cosine").build(p).search(external(p), 1).select("i", "j", F.abs(F.round("d", 6)).alias("d"))


@query
def binary_neighbours(spark, sf_dir):
    """Jaccard neighbours by the signs of components."""
    bits = points(spark, sf_dir).select("id", F.transform("v", lambda x: (x > 0).cast("int")).alias("v"))
    return VectorIndex("jaccard").build_from_binary(bits).query_knn(K)


@query
def index_additions(spark, sf_dir):
    """A tenth of the vectors joins an index of the others, under keys of its own; the stated queries ask."""
    p = points(spark, sf_dir)
    index = VectorIndex("euclidean").build_from_vectors(p.where("id % 10 <> 9"))
    index.add(p.where("id % 10 = 9"))
    return index.query_batch(external(p), K)


@query
def knn_jaccard_tokens(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return knn.jaccard_knn(t, K, external(t))


@query
def knn_jaccard_prefix(spark, sf_dir):
    """As ``knn_jaccard_tokens``, by joins of prefixes, whatever the size."""
    t = tokens(spark, sf_dir)
    return prefix.jaccard_by_prefix(t.toDF("j", "s"), external(t).toDF("i", "s"), K, False)


@query
def recall_at_k(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.recall(stored(knn.exact_knn(p, K, "cosine")), knn.exact_knn(p, K, "euclidean"), K)


@query
def neighbour_report(spark, sf_dir):
    """Q9: labels and the mean place of the nearest."""
    p = points(spark, sf_dir)
    near = knn.exact_knn(p, K, "cosine", external(p)).join(labels(spark, sf_dir).withColumnRenamed("id", "j"), "j").join(coords(spark, sf_dir).withColumnRenamed("id", "j"), "j")
    return near.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"].cast("string")), ",").alias("labels"), F.avg("x").alias("x"), F.avg("y").alias("y"))


# Signatures


@query
def minhash_signature(spark, sf_dir):
    return signatures(spark, sf_dir).select("id", F.posexplode("sig").alias("p", "h"))


@query
def signature_distances(spark, sf_dir):
    """From document 0 to all."""
    s = stored(signatures(spark, sf_dir))
    one = F.broadcast(s.where("id = 0").select(F.col("sig").alias("one")))
    return s.crossJoin(one).select(F.col("id").alias("j"), encode.signature_distance(F.col("sig"), F.col("one")).alias("d"))


@query
def lsh_bands(spark, sf_dir):
    b = encode.bands(signatures(spark, sf_dir), BANDS).groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("largest"))


@query
def lsh_candidates(spark, sf_dir):
    return index(spark, sf_dir).candidates(budget=50)


@query
def lsh_knn(spark, sf_dir):
    return index(spark, sf_dir).knn_graph(K, 10)


@query
def lsh_query(spark, sf_dir):
    idx = index(spark, sf_dir)
    return idx.query(external(idx.sigs), K, 10)


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of bands of one value finds for the stated queries."""
    t = stored(token_ids(spark, sf_dir))
    idx = SignatureIndex(PERMUTATIONS, PERMUTATIONS).add(encode.minhash(t, PERMUTATIONS, SEED)).build()
    return idx.search(external(t), t, K)


@query
def lsh_search(spark, sf_dir):
    return searched(spark, sf_dir)


@query
def lsh_recall(spark, sf_dir):
    """Whether that index finds nine of ten exact neighbours of the stated queries, or more."""
    t = tokens(spark, sf_dir)
    true = stored(knn.jaccard_knn(t, K, external(t)))
    n = knn.recall(true, searched(spark, sf_dir), K)
    return n.select("n", (F.col("recall") >= 0.9).alias("enough"))


@query
def lsh_deepening(spark, sf_dir):
    """Whether prefix trees find nine of ten exact neighbours of the stated queries, or more, among fewer pairs than all."""
    t = stored(token_ids(spark, sf_dir))
    asked = external(t)
    idx = SignatureIndex(128, 32).add(encode.minhash(t, 128, SEED)).build()
    n = knn.recall(stored(knn.jaccard_knn(t, K, asked)), idx.nearest(asked, t, K), K)
    return n.select("n", (F.col("recall") >= 0.9).alias("enough"), F.lit(sum(idx.compared) < asked.count() * idx.size).alias("fewer"))


@query
def weighted_minhash(spark, sf_dir):
    """Rows only: the samples come from a published scheme with seeded draws."""
    v = points(spark, sf_dir).select("id", F.transform("v", lambda x: F.abs(x) + 0.001).alias("v"))
    return encode.weighted_minhash(v, 64, 16, SEED).select("id", F.posexplode("sig").alias("p", "s")).select("id", "p", "s.k", "s.y")


# Graphs and trees


@query
def knn_edges(spark, sf_dir):
    return graph.edges_from_graph(neighbour_graph(spark, sf_dir))


@query
def clean_edges(spark, sf_dir):
    """similarity edges with negative weights and loops."""
    near = neighbour_graph(spark, sf_dir)
    raw = near.select(F.col("i").alias("u"), F.col("j").alias("v"), (F.col("d") - 0.6).alias("w"))
    return graph.clean_edges(raw, (points(spark, sf_dir).agg(F.max("id")).first()[0] or 0) + 1)


@query
def mst_edges(spark, sf_dir):
    return forest(spark, sf_dir)


@query
def connected_components(spark, sf_dir):
    """Of the graph of nearest neighbours."""
    return graph.components(graph.edges_from_graph(neighbour_graph(spark, sf_dir, 1)))


@query
def component_count(spark, sf_dir):
    p = points(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"))
    e = graph.spanning_forest(graph.edges_from_graph(neighbour_graph(spark, sf_dir, 1))).agg(F.count(F.lit(1)).alias("edges"))
    return p.crossJoin(e).select("nodes", "edges", (F.col("nodes") - F.col("edges")).alias("components"))


@query
def degree_root(spark, sf_dir):
    return graph.degree_root(forest(spark, sf_dir))


@query
def tree_bfs(spark, sf_dir):
    return rooted(spark, sf_dir).select("node", "root", "parent", "depth", "bfs")


@query
def tree_dfs(spark, sf_dir):
    return rooted(spark, sf_dir).select("node", "dfs")


@query
def subtree_sizes(spark, sf_dir):
    return rooted(spark, sf_dir).select("node", "size")


@query
def tree_distances(spark, sf_dir):
    return tree.distances_from(forest(spark, sf_dir), 0, points(spark, sf_dir).select("id"))


@query
def tree_path(spark, sf_dir):
    return tree.path(rooted(spark, sf_dir), 3, 77)


@query
def sql_tree_path(spark, sf_dir):
    """G12 by a table function of SQL."""
    sql.register_tree(spark, rooted(spark, sf_dir), "canopy_path")
    return spark.sql("SELECT pos, node FROM canopy_path(77, 11)")


@query
def sql_nearest(spark, sf_dir):
    """A12 by a table function with stated partitions: the three cheapest orders of each customer."""
    sql.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("canopy_orders")
    return spark.sql("SELECT i, rank, j, d FROM nearest(TABLE(SELECT o_custkey AS i, o_orderkey AS j, o_totalprice AS d FROM canopy_orders), 3)")


@query
def pair_distances(spark, sf_dir):
    """From every node whose id is divisible by 20 to all nodes."""
    at = rooted(spark, sf_dir)
    a = at.where("node % 20 = 0").select(F.col("node").alias("a"))
    return PathIndex(at).from_each(a)


@query
def pair_paths(spark, sf_dir):
    """The ways from the nodes whose id is divisible by 20 to the nodes of 37 more."""
    at = rooted(spark, sf_dir)
    pairs = at.where("node % 20 = 0").select(F.col("node").alias("a"), (F.col("node") + 37).alias("b"))
    return PathIndex(at).paths(pairs.join(at.select(F.col("node").alias("b")), "b", "left_semi"))


@query
def tree_ball(spark, sf_dir):
    return tree.subtree(forest(spark, sf_dir), 10, 4)


@query
def path_distance(spark, sf_dir):
    """G13."""
    return spark.createDataFrame([(3, 77, tree.distance(rooted(spark, sf_dir), 3, 77))], "a long, b long, distance double")


@query
def pseudotime(spark, sf_dir):
    """Q12: distances from the node of greatest value."""
    start = values(spark, sf_dir).agg(F.max_by("id", F.struct("value", -F.col("id")))).first()[0]
    return tree.distances_from(forest(spark, sf_dir), start, points(spark, sf_dir).select("id"))


# Analysis


@query
def boundary_edges(spark, sf_dir):
    return analysis.boundary_edges(forest(spark, sf_dir), labels(spark, sf_dir)).select("u", "v", "w", "label_u", "label_v")


@query
def confusion_matrix(spark, sf_dir):
    return analysis.confusion(forest(spark, sf_dir), labels(spark, sf_dir))


@query
def edge_delta(spark, sf_dir):
    return analysis.edge_delta(forest(spark, sf_dir), values(spark, sf_dir))


@query
def path_properties(spark, sf_dir):
    return analysis.path_properties(rooted(spark, sf_dir), 3, 77, values(spark, sf_dir))


@query
def node_diversity(spark, sf_dir):
    mst, nodes = forest(spark, sf_dir), points(spark, sf_dir).select("id")
    out = analysis.diversity(mst, nodes).withColumnRenamed("diversity", "mean")
    for how in ("max", "median"):
        out = out.join(analysis.diversity(mst, nodes, how).withColumnRenamed("diversity", how), "node")
    return out


@query
def subtree_purity(spark, sf_dir):
    return analysis.purity(rooted(spark, sf_dir), labels(spark, sf_dir))


@query
def boundary_rate(spark, sf_dir):
    return analysis.boundary_rate(forest(spark, sf_dir), labels(spark, sf_dir))


@query
def purity_summary(spark, sf_dir):
    return analysis.purity_summary(analysis.purity(rooted(spark, sf_dir), labels(spark, sf_dir)))


@query
def top_label_pairs(spark, sf_dir):
    return analysis.top_label_pairs(forest(spark, sf_dir), labels(spark, sf_dir))


@query
def label_route(spark, sf_dir):
    return analysis.label_route(rooted(spark, sf_dir), labels(spark, sf_dir), 0, 7)


@query
def label_coherence(spark, sf_dir):
    return analysis.coherence(forest(spark, sf_dir), labels(spark, sf_dir))


@query
def steep_edges(spark, sf_dir):
    return analysis.steep_edges(forest(spark, sf_dir), values(spark, sf_dir))


@query
def mislabelled(spark, sf_dir):
    return analysis.mislabelled(predictions(spark, sf_dir))


@query
def failure_paths(spark, sf_dir):
    return analysis.failure_paths(rooted(spark, sf_dir), stored(predictions(spark, sf_dir)), values(spark, sf_dir))


# Places


@query
def tree_layout(spark, sf_dir):
    """Rows only: places are this engine's own."""
    e = graph.edges_from_graph(neighbour_graph(spark, sf_dir))
    return layout.layout_from_edges(points(spark, sf_dir).select("id"), e)[0]


@query
def layout_in_levels(spark, sf_dir):
    """Rows only: the tree of the neighbour graph in levels, with far forces, whatever its size."""
    e = graph.edges_from_graph(neighbour_graph(spark, sf_dir))
    config = layout.LayoutConfig(task_nodes=256, fme_iterations=16, merger="Solar", placer="Solar")
    return layout.layout_from_edges(points(spark, sf_dir).select("id"), e, config)[0]


@query
def component_shelves(spark, sf_dir):
    """Boxes of quantity by line number, one for each customer, packed in shelves."""
    of = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("root"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    boxes = lines.join(of, "o_orderkey").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return layout.shelves(boxes)


@query
def transform_positions(spark, sf_dir):
    """M3, M5 without jitter: a tenth of the vectors placed among the others."""
    p = points(spark, sf_dir)
    old, new = stored(p.where("id % 10 <> 9")), p.where("id % 10 = 9")
    model = TreeMap(K, "cosine")
    model._embedding = stored(coords(spark, sf_dir).where("id % 10 <> 9"))
    model._graph = stored(knn.exact_knn(old, K, "cosine"))
    return model.position(new.select("id"), stored(knn.exact_knn(old, K, "cosine", new)), jitter=0.0)


@query
def added_points_tree(spark, sf_dir):
    """M1, M4, M6: the tree of a fitted model after a tenth of the vectors was added."""
    p = points(spark, sf_dir)
    model = TreeMap(K, "cosine", layout_iterations=20).fit(p.where("id % 10 <> 9"))
    model.add_points(p.where("id % 10 = 9"))
    return model.tree_


@query
def kneighbors(spark, sf_dir):
    """Neighbours among the fitted rows of rows that aren't."""
    p = points(spark, sf_dir)
    model = TreeMap(K, "euclidean", layout_iterations=1).fit(p.where("id % 10 <> 9"))
    return model.kneighbors(p.where("id % 10 = 9"))


@query
def normalize_coords(spark, sf_dir):
    return scalars.normalize(coords(spark, sf_dir))


@query
def normalize_axes(spark, sf_dir):
    return scalars.normalize_axes(coords(spark, sf_dir))


@query
def quantize_coords(spark, sf_dir):
    n = scalars.normalize(coords(spark, sf_dir)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    q = n.select("id", scalars.quantize(F.col("x")).alias("qx"), scalars.quantize(F.col("y")).alias("qy"))
    return q.withColumn("x", scalars.dequantize(F.col("qx"))).withColumn("y", scalars.dequantize(F.col("qy")))


@query
def colour_positions(spark, sf_dir):
    return scalars.colour_position(table(spark, sf_dir, "events"), "value").select("event_id", "position")


# Tables of points


@query
def category_codes(spark, sf_dir):
    return scalars.encode(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", "c_mktsegment_code")


@query
def value_histogram(spark, sf_dir):
    return facets.histogram(table(spark, sf_dir, "events"), "value")


@query
def facet_top(spark, sf_dir):
    return facets.facet_counts(table(spark, sf_dir, "documents"), "source", 15, "doc_id")


@query
def facet_recount(spark, sf_dir):
    """A5: facets of what filters leave."""
    left = facets.in_range(facets.in_categories(table(spark, sf_dir, "documents"), "lang", ["de", "fr"]), "n_chars", 100, 2000)
    return facets.facet_counts(left, "source", 15, "doc_id")


@query
def other_filter(spark, sf_dir):
    return facets.in_categories(table(spark, sf_dir, "customer"), "c_nationkey", ["3", facets.OTHER]).select("c_custkey", "c_nationkey")


@query
def range_filter(spark, sf_dir):
    return facets.in_range(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20000.0, 30000.0).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query
def text_search(spark, sf_dir):
    return facets.search(table(spark, sf_dir, "documents"), "text", " LICENSE ").select("doc_id", "lang", "source")


@query
def row_subset(spark, sf_dir):
    """customers with an order above 400,000."""
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")
    return facets.subset(table(spark, sf_dir, "customer"), "c_custkey", ids).select("c_custkey", "c_name", "c_acctbal")


@query
def sample_quotas(spark, sf_dir):
    """A10: how many of each group a sample of 500 has."""
    s = facets.stratified_sample(table(spark, sf_dir, "events"), "event_id", "event_type", 500, mode="balanced")
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def text_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.obs_to_numeric(F.col("c_name")).alias("number"), scalars.obs_to_numeric(F.col("c_mktsegment")).alias("none"))


@query
def cell_metadata(spark, sf_dir):
    return cells.cell_metadata(table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"])


@query
def marker_scores(spark, sf_dir):
    """Orders as cells, suppliers as genes, quantities as expression."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").cast("string").alias("gene"), F.lit("X").alias("layer"), F.col("l_quantity").alias("value"))
    genes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("gene"))
    return cells.marker_scores(x, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell")), genes, ["1", "2", "3", "4"])


@query
def item_set_jaccard(spark, sf_dir):
    """Customers by the parts in their orders; a twentieth of them ask."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sets = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("l_partkey").alias("on"))
    sets = stored(sets)
    return knn.jaccard_knn(sets, K, external(sets))


@query
def sequence_properties(spark, sf_dir):
    names = tuple(p for p in proteins.PROPERTIES if p != "isoelectric_point")
    return proteins.sequence_properties(sequences(spark, sf_dir), "seq", names).drop("seq")


# Saved and loaded again


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/canopy-saved-{uuid.uuid4().hex}"


@query
def saved_signatures(spark, sf_dir):
    """An index saved with rows that wait, loaded, completed and asked."""
    sigs, path = stored(signatures(spark, sf_dir)), folder(spark)
    SignatureIndex(PERMUTATIONS, BANDS, keep_empty=True).add(sigs.where("id % 2 = 0")).build().add(sigs.where("id % 2 = 1")).save(path)
    idx = SignatureIndex.load(spark, path).build()
    return idx.query(external(idx.sigs), K, 10)


@query
def saved_index(spark, sf_dir):
    """Vectors saved, loaded and added to before they are asked."""
    p, path = points(spark, sf_dir), folder(spark)
    VectorIndex("euclidean").build_from_vectors(p.where("id % 10 <> 9")).save(path)
    idx = VectorIndex.load(spark, path)
    idx.add(p.where("id % 10 = 9"))
    return idx.query_batch(external(p), K)


@query
def saved_model(spark, sf_dir):
    """A fitted model saved, loaded and asked."""
    p, path = points(spark, sf_dir), folder(spark)
    TreeMap(K, "euclidean", layout_iterations=1).fit(p.where("id % 10 <> 9")).save(path)
    return TreeMap.load(spark, path).kneighbors(p.where("id % 10 = 9"))


@query
def signature_scan(spark, sf_dir):
    """Document 0 against the members with an even id."""
    idx = index(spark, sf_dir)
    return idx.linear_scan(idx.signature(0), idx.sigs.where("id % 2 = 0").select("id"), 10)


@query
def neighbour_ids(spark, sf_dir):
    """N11."""
    return index(spark, sf_dir).neighbour_ids(K, 10)


@query
def node_neighbours(spark, sf_dir):
    """Around node 3 of the spanning forest."""
    return tree.neighbours(forest(spark, sf_dir), 3)


@query
def tree_edge_weights(spark, sf_dir):
    """Edges of the forest with weights of a graph that lacks a third of them."""
    edges = stored(graph.edges_from_graph(neighbour_graph(spark, sf_dir)))
    return graph.tree_weights(graph.spanning_forest(edges), edges.where("u % 3 <> 0"))


# Streams over tables


@query
def stream_neighbours(spark, sf_dir):
    """M4 as a stream with state, all cells asked: each vector's neighbours among those before it, two a minute."""
    k, cells = K, 8
    rows = points(spark, sf_dir).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 2) * 60).alias("at"), "v")
    base = f"{shared_dir(spark)}/canopy-stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    fitted = Cells(rows.select("id", "v"), cells)
    # a row in the far future moves the watermark past all others
    last = rows.orderBy("id").limit(1).select(F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"), "v")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):
            stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
            neighbour_stream(stream, fitted, k, f"{base}/out", f"{base}/mark", cells).awaitTermination()
            last.write.mode("append").parquet(f"{base}/in")
    finally:
        spark.conf.set(key, before)
    return nearest_of(spark.read.schema(LISTS).parquet(f"{base}/out"), k).where("i >= 0")


# Files, written from tables


def text_file(df: DataFrame, column: str = "value") -> str:
    """One text file of rows in order, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/canopy-text-{uuid.uuid4().hex}"
    df.select(column).coalesce(1).write.text(path)
    return path


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("item_"), "item_id").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "").alias("letters"))


@query
def fasta_records(spark, sf_dir):
    """S2."""
    lines = items(spark, sf_dir).select(F.concat_ws("\n", F.concat(F.lit(">"), "name", F.lit(" of a test")), F.substring("letters", 1, 40), F.lit(""), F.substring(F.col("letters"), F.lit(41), F.length("letters"))).alias("value"))
    return readers.read_fasta(spark, text_file(lines)).select("id", "sequence")


@query
def sequence_table(spark, sf_dir):
    """S3."""
    rows = items(spark, sf_dir).select(F.concat_ws("\t", "name", "letters", F.lit("x")).alias("value"))
    head = spark.createDataFrame([("id\tsequence\tnote",)], "value string")
    return readers.read_protein_csv(spark, text_file(head.unionByName(rows)))


@query
def id_list(spark, sf_dir):
    """Numbers of customers as accessions, some of them of the right form."""
    n = F.col("c_custkey")
    made = F.when(n % 3 == 0, F.concat(F.lit("P"), F.lpad(n.cast("string"), 5, "0"))).when(n % 3 == 1, F.concat(F.lit("A0A"), F.lpad(n.cast("string"), 7, "0"))).otherwise(F.concat(F.lit("Q1B"), F.lpad(n.cast("string"), 3, "7")))
    return readers.read_id_list(spark, text_file(table(spark, sf_dir, "customer").select(F.concat(F.lit("  "), made, F.lit(" # of a customer")).alias("value"))))


@query
def alignment_graph(spark, sf_dir):
    """Hits between vectors as tabular output, in order of query and rank."""
    near = neighbour_graph(spark, sf_dir)
    fields = [F.concat(F.lit("v"), "i"), F.concat(F.lit("v"), "j"), *[F.lit("0")] * 9, F.format_string("%.4f", 100 * (2 - F.col("d")))]
    lines = near.orderBy("i", "rank").select(F.concat_ws("\t", *fields).alias("value"))
    return readers.parse_alignment(spark, text_file(lines), 3)[0]


@query
def alignment_ids(spark, sf_dir):
    """Ids in order of first appearance."""
    near = neighbour_graph(spark, sf_dir)
    fields = [F.concat(F.lit("v"), "i"), F.concat(F.lit("v"), "j"), *[F.lit("0")] * 9, F.lit("50")]
    lines = near.orderBy("i", "rank").select(F.concat_ws("\t", *fields).alias("value"))
    return readers.parse_alignment(spark, text_file(lines), 3)[1]


def text_folder(df: DataFrame, *by: str) -> str:
    """A folder of text files of the column ``value``, or one for each value of ``by``, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/canopy-texts-{uuid.uuid4().hex}"
    df.select(*by, "value").write.partitionBy(*by).text(path)
    return path


@query
def fasta_ranges(spark, sf_dir):
    """S2 as a format: records in ranges of 64 KB, letters of records that filters leave."""
    seqs = sequences(spark, sf_dir).where("seq <> ''")
    lines = seqs.select(F.concat(F.lit(">doc_"), "id", F.lit(" letters\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    formats.register(spark)
    read = spark.read.format("fasta").option("splitBytes", 1 << 16).schema("id string, length long, sequence string").load(text_folder(lines))
    return read.where(F.col("id").startswith("doc_1") & (F.col("length") >= 200))


@query
def blast_graph(spark, sf_dir):
    """S7 as a format: files in order, hits by file and byte."""
    fields = [F.concat(F.lit("v"), "i"), F.concat(F.lit("v"), "j"), *[F.lit("0")] * 9, F.format_string("%.4f", 100 * (2 - F.col("d")))]
    lines = neighbour_graph(spark, sf_dir).orderBy("i", "rank").select(F.concat_ws("\t", *fields).alias("value"))
    formats.register(spark)
    hits = spark.read.format("blast").schema("query string, subject string, bitscore double, file string, at long").load(text_folder(lines))
    return readers.graph_of_hits(hits.select("file", "at", F.col("query").alias("q"), F.col("subject").alias("s"), F.col("bitscore").alias("x")), ["file", "at"], 3)[0]


@query
def pdb_structures(spark, sf_dir):
    """Test items as structures of alpha carbons, a file each."""
    residue = F.create_map(*[F.lit(x) for three, one in readers.RESIDUES.items() for x in (one, three)])
    letters = F.split(F.regexp_replace(F.upper("letters"), "[^ACDEFGHIKLMNPQRSTVWY]", ""), "")
    each = items(spark, sf_dir).select("item_id", "name", F.posexplode_outer(F.filter(letters, lambda x: x != "")).alias("place", "letter"))
    n = F.col("place") + 1
    atom = F.format_string("ATOM  %5d  CA  %s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", n % 100000, residue[F.col("letter")], n % 10000, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), n * 37 % 100 + F.lit(0.25))
    head = items(spark, sf_dir).select("name", F.lit(-1).alias("place"), F.concat(F.lit("HEADER"), F.repeat(F.lit(" "), 56), F.lpad(F.col("item_id").cast("string"), 4, "0")).alias("value"))
    lines = head.unionByName(each.where("letter IS NOT NULL").select("name", "place", atom.alias("value"))).repartition("name").sortWithinPartitions("name", "place")
    formats.register(spark)
    return spark.read.format("pdb").option("pathGlobFilter", "*.txt").load(text_folder(lines, "name")).drop("file")


@query
def selection_export(spark, sf_dir):
    """Written and read again."""
    c = table(spark, sf_dir, "customer").withColumn("c_name", F.concat("c_name", F.lit(', "the\tgreat"')))
    path = f"{shared_dir(spark)}/canopy-csv-{uuid.uuid4().hex}"
    facets.export_selection(c, table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey"), "c_custkey", ["c_custkey", "c_name"], path)
    return spark.read.schema("c_custkey long, c_name string").option("header", True).option("escape", '"').csv(path)


@query
def isoelectric_point(spark, sf_dir):
    """A bisection of a hundred steps."""
    return proteins.sequence_properties(sequences(spark, sf_dir), "seq", ("isoelectric_point",)).drop("seq")


@query
def kmer_features(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("seq"))
    return proteins.kmers(b, "id", "seq", 3)


__all__ = ["ORACLE_SQL", "QUERIES"]
