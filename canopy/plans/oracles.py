"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from canopy.functions.encode import MASK, PRIME, permutations
from canopy.functions.proteins import ACIDIC, BASIC, C_TERMINUS, GROUPS, HYDROPATHY, MASS, N_TERMINUS, WATER

K, PERMUTATIONS, BANDS, SEED = 5, 32, 8, 42

POINTS = "e AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def neighbours(name: str, k: int, f: str = "list_cosine_distance", left: str = "e", right: str = "e", other: str = "a.id <> b.id") -> str:
    return f"""{name} AS MATERIALIZED (SELECT i, rank, j, d FROM (SELECT a.id AS i, b.id AS j, {f}(a.v, b.v) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY {f}(a.v, b.v), b.id) AS rank FROM {left} a JOIN {right} b ON {other}) WHERE rank <= {k})"""


GRAPH = f"{POINTS}, {neighbours('g', K)}"
EDGES = f"{GRAPH}, k AS MATERIALIZED (SELECT least(i, j) AS u, greatest(i, j) AS v, min(d) AS w FROM g GROUP BY ALL)"


def kruskal(edges: str = "k", out: str = "mst") -> str:
    """Edges in order of (w, u, v); labels of all nodes in a list, as they are after each edge."""
    return f"""ordered AS MATERIALIZED (SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS n FROM {edges}),
lab(n, l) AS (SELECT 0::BIGINT, (SELECT list(id ORDER BY id) FROM e) UNION ALL
  SELECT o.n, list_transform(l, lambda q: CASE WHEN q = greatest(l[o.u + 1], l[o.v + 1]) THEN least(l[o.u + 1], l[o.v + 1]) ELSE q END) FROM lab JOIN ordered o ON o.n = lab.n + 1),
{out} AS MATERIALIZED (SELECT u, v, w FROM ordered o JOIN lab ON lab.n = o.n - 1 WHERE l[u + 1] <> l[v + 1])"""


MST = f"{EDGES}, {kruskal()}, s AS MATERIALIZED (SELECT u AS a, v AS b, w FROM mst UNION ALL SELECT v, u, w FROM mst)"
ROOT = "top AS MATERIALIZED (SELECT a AS node, count(*) AS degree FROM s GROUP BY a ORDER BY degree DESC, node LIMIT 1)"


def spread(start: str, name: str = "t") -> str:
    """Paths from a node to all nodes of its tree."""
    return f"""{name}(node, parent, depth, dist, path) AS (SELECT id, NULL::BIGINT, 0, 0::DOUBLE, [id] FROM ({start}) UNION ALL
  SELECT s.b, {name}.node, {name}.depth + 1, {name}.dist + s.w, list_append({name}.path, s.b) FROM {name} JOIN s ON s.a = {name}.node WHERE s.b IS DISTINCT FROM {name}.parent)"""


WALKS = """walks(src, node, parent, hops, dist, path) AS (SELECT id, id, NULL::BIGINT, 0, 0::DOUBLE, [id] FROM e WHERE id % 20 = 0 UNION ALL
  SELECT src, s.b, walks.node, hops + 1, walks.dist + s.w, list_append(walks.path, s.b) FROM walks JOIN s ON s.a = walks.node WHERE s.b IS DISTINCT FROM walks.parent)"""

# All trees: that of the root of greatest degree, and the others from their least nodes
COMPONENT = "comp(a, b) AS (SELECT id, id FROM e UNION SELECT comp.a, s.b FROM comp JOIN s ON s.a = comp.b), least_of AS (SELECT a AS node, min(b) AS low FROM comp GROUP BY a)"
STARTS = "starts AS MATERIALIZED (SELECT node AS id FROM top UNION ALL SELECT DISTINCT low FROM least_of WHERE low <> (SELECT low FROM least_of JOIN top USING (node)))"
TREE = f"{MST}, {ROOT}, {COMPONENT}, {STARTS}, {spread('SELECT id FROM starts')}, rooted AS MATERIALIZED (SELECT node, path[1] AS root, parent, depth, dist, path FROM t)"
SIZES = "sizes AS MATERIALIZED (SELECT q AS node, count(*) AS size FROM (SELECT unnest(path) AS q FROM rooted) GROUP BY q)"
PURITY = """below AS MATERIALIZED (SELECT q AS node, label, count(*) AS c FROM (SELECT node AS n2, unnest(path) AS q FROM rooted) x JOIN e ON e.id = x.n2 GROUP BY ALL),
pure AS MATERIALIZED (SELECT node, size, CASE WHEN size >= 10 THEN max(c)::DOUBLE / size END AS purity FROM below JOIN sizes USING (node) GROUP BY node, size)"""
LABELLED = "le AS MATERIALIZED (SELECT mst.u, mst.v, mst.w, x.label AS label_u, y.label AS label_v, x.x AS x_u, y.x AS x_v FROM mst JOIN e x ON x.id = mst.u JOIN e y ON y.id = mst.v)"


def path_between(a: int, b: int) -> str:
    return f"{MST}, {spread(f'SELECT {a}::BIGINT AS id')}, way AS (SELECT unnest(path) AS node, generate_subscripts(path, 1) - 1 AS pos FROM t WHERE node = {b})"


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_a, _b = permutations(PERMUTATIONS, SEED)
TOKENS = r"tok AS MATERIALIZED (SELECT DISTINCT doc_id AS id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \n]+')) AS t FROM documents) WHERE t <> '')"
SIGNATURES = f"""{TOKENS}, perm(p, a, b) AS (VALUES {", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(_a.tolist(), _b.tolist(), strict=True)))}),
ids AS MATERIALIZED (SELECT id, ('0x' || md5(t)[1:15])::BIGINT AS x FROM tok),
sig AS MATERIALIZED (SELECT id, p, min(((a * x + b) % 18446744073709551616) % {PRIME} & {MASK})::BIGINT AS h FROM ids, perm GROUP BY id, p),
full_sig AS MATERIALIZED (SELECT d.doc_id AS id, perm.p, coalesce(h, {MASK}) AS h FROM documents d CROSS JOIN perm LEFT JOIN sig ON sig.id = d.doc_id AND sig.p = perm.p),
sl AS MATERIALIZED (SELECT id, list(h ORDER BY p) AS s FROM full_sig GROUP BY id),
band AS MATERIALIZED (SELECT id, b AS band, s[b * {PERMUTATIONS // BANDS} + 1 : (b + 1) * {PERMUTATIONS // BANDS}] AS h FROM sl, range({BANDS}) r(b))"""
CANDIDATES = """cand AS MATERIALIZED (SELECT i, j, first_band FROM (SELECT i, j, first_band, row_number() OVER (PARTITION BY i ORDER BY first_band, j) AS r FROM (SELECT x.id AS i, y.id AS j, min(x.band) AS first_band FROM band x JOIN band y ON x.band = y.band AND x.h = y.h GROUP BY ALL)) WHERE r <= 50)"""


def signature_rank(where: str) -> str:
    return f"""dist AS (SELECT i, j, 1 - len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2]))::DOUBLE / {PERMUTATIONS} AS d FROM cand JOIN sl a ON a.id = i JOIN sl b ON b.id = j WHERE {where})
SELECT i, rank, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist) WHERE rank <= {K}"""


def jaccard(members: str, who: str) -> str:
    return f"""n AS (SELECT id, count(*) AS n FROM {members} GROUP BY id),
both_of AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM {members} a JOIN {members} b USING (t) WHERE {who} GROUP BY ALL),
jd AS (SELECT i, j, 1 - c::DOUBLE / (x.n + y.n - c) AS d FROM both_of JOIN n x ON x.id = i JOIN n y ON y.id = j)
SELECT i, rank, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM jd) WHERE rank <= {K}"""


def residues(letters: dict[str, float] | str) -> str:
    if isinstance(letters, str):
        letters = dict.fromkeys(letters, 1)
    return "(" + " + ".join(f"{w}::DOUBLE * (length(seq) - length(replace(seq, '{r}', '')))" for r, w in letters.items()) + ")"


def count_of(r: str) -> str:
    return f"(length(seq) - length(replace(seq, '{r}', '')))"


SEQUENCES = "sq AS (SELECT doc_id AS id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM documents)"


def charge(ph: str, count) -> str:
    return (
        f"1 / (1 + pow(10.0, {ph} - {N_TERMINUS})) + " + " + ".join(f"{count(r)} / (1 + pow(10.0, {ph} - {k}))" for r, k in BASIC.items())
        + f" - 1 / (1 + pow(10.0, {C_TERMINUS} - {ph})) - " + " - ".join(f"{count(r)} / (1 + pow(10.0, {k} - {ph}))" for r, k in ACIDIC.items())
    )


CHARGE = charge("7.0", count_of)
PROPERTIES = {
    "length": "length(seq)::DOUBLE", "molecular_weight": f"{residues(MASS)} + {WATER}", "gravy": f"{residues(HYDROPATHY)} / length(seq)", "charge_at_ph7": CHARGE,
    "aromaticity": f"{residues(GROUPS['aromaticity'])}::DOUBLE / length(seq)",
    "aliphatic_index": f"100 * ({count_of('A')} + 2.9 * {count_of('V')} + 3.9 * ({count_of('I')} + {count_of('L')})) / length(seq)",
    **{g: f"{residues(letters)}::DOUBLE / length(seq)" for g, letters in GROUPS.items() if g != "aromaticity"}, "n_cysteines": f"{count_of('C')}::DOUBLE",
}

RANGE = "r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM e)"
NORMAL = f"{POINTS}, {RANGE}, nm AS (SELECT id, (x - (x0 + x1) / 2) / (greatest(x1 - x0, y1 - y0) / 2) AS x, (y - (y0 + y1) / 2) / (greatest(x1 - x0, y1 - y0) / 2) AS y FROM e, r)"

OLD_AND_NEW = f"{POINTS}, old AS MATERIALIZED (SELECT * FROM e WHERE id % 10 <> 9), new AS MATERIALIZED (SELECT * FROM e WHERE id % 10 = 9)"
ITEMS = "items AS (SELECT 'item_' || item_id AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM benchmark)"
# Hits in the order of the file, and the ids that names have by first appearance
HITS = f"""{GRAPH}, lines AS (SELECT i, j, row_number() OVER (ORDER BY i, rank) AS line, (100 * (2 - d)) AS x FROM g),
seen AS (SELECT name, min(pl) AS pl FROM (SELECT i AS name, 2 * line AS pl FROM lines UNION ALL SELECT j, 2 * line + 1 FROM lines) GROUP BY name),
names AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY pl) - 1 AS id FROM seen)"""

ORACLE_SQL: dict[str, str] = {
    "approximate_recall": "SELECT count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "cell_index_recall": "SELECT count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "graph_search_recall": "SELECT count(*) FILTER (vec_id % 20 = 0) AS n, true AS found, count(*) AS members, true AS listed FROM embeddings",
    "graph_search_nearest": q(f"{POINTS}, qs AS (SELECT * FROM e WHERE id % 20 = 0), {neighbours('g', 1, left='qs', other='TRUE')}", "SELECT i, j, abs(round(d, 6)) AS d FROM g"),
    "binary_neighbours": q(
        f"{POINTS}, bits AS MATERIALIZED (SELECT id, list_filter(range(1, len(v) + 1), lambda p: v[p] > 0) AS s FROM e),",
        f"""c AS MATERIALIZED (SELECT a.id AS i, b.id AS j, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM bits a JOIN bits b ON a.id <> b.id)
        SELECT i, rank, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT i, j, 1 - c::DOUBLE / (n - c) AS d FROM c WHERE c > 0)) WHERE rank <= {K}""",
    ),
    "index_additions": q(
        f"{OLD_AND_NEW}, top AS (SELECT max(id) AS m FROM old), held AS MATERIALIZED (SELECT id, v FROM old UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY id), v FROM new), qs AS (SELECT * FROM e WHERE id % 20 = 0), {neighbours('g', K, 'list_distance', 'qs', 'held', 'TRUE')}",
        "SELECT i, rank, j, round(d, 6) AS d FROM g",
    ),
    "kneighbors": q(f"{OLD_AND_NEW}, {neighbours('g', K, 'list_distance', 'new', 'old', 'TRUE')}", "SELECT i, rank, j, round(d, 6) AS d FROM g"),
    "added_points_tree": q(
        f"{OLD_AND_NEW}, {neighbours('g', K, left='old', right='old')}, k AS MATERIALIZED (SELECT least(i, j) AS u, greatest(i, j) AS v, min(d) AS w FROM g GROUP BY ALL), {kruskal()}, {neighbours('h', 1, left='new', right='old', other='TRUE')}",
        "SELECT u, v, round(w, 6) AS w FROM mst UNION ALL SELECT least(i, j), greatest(i, j), round(d, 6) FROM h",
    ),
    "path_distance": q(f"{MST}, {spread('SELECT 3::BIGINT AS id')}", "SELECT 3::BIGINT AS a, 77::BIGINT AS b, round(dist, 6) AS distance FROM t WHERE node = 77"),
    "failure_paths": q(
        f"""{MST}, {neighbours('near', 1)}, p AS MATERIALIZED (SELECT i AS id, a.label, b.label AS predicted FROM near JOIN e a ON a.id = i JOIN e b ON b.id = j),
wrong AS MATERIALIZED (SELECT id, label FROM p WHERE label <> predicted), goals AS MATERIALIZED (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM p WHERE label = predicted) WHERE r <= 20),
walk(start, node, parent, hops, path) AS (SELECT id, id, NULL::BIGINT, 0, [id] FROM wrong UNION ALL SELECT walk.start, s.b, walk.node, hops + 1, list_append(path, s.b) FROM walk JOIN s ON s.a = walk.node WHERE s.b IS DISTINCT FROM walk.parent),
best AS (SELECT start, min((hops, node)) AS m FROM walk JOIN wrong ON wrong.id = start JOIN goals ON goals.id = node AND goals.label = wrong.label GROUP BY start),
far AS (SELECT start, m[1] AS hops, m[2] AS goal FROM best ORDER BY hops DESC, start LIMIT 5)""",
        "SELECT start AS node, goal AS \"to\", far.hops::BIGINT AS hops, round(min(x), 6) AS least FROM far JOIN (SELECT start AS start2, node, unnest(path) AS q FROM walk) w ON start2 = start AND node = goal JOIN e ON e.id = q GROUP BY ALL",
    ),
    "fasta_records": f"WITH {ITEMS} SELECT name AS id, letters AS sequence FROM items",
    "sequence_table": f"WITH {ITEMS} SELECT name AS id, letters AS sequence FROM items",
    "id_list": "WITH m AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'P' || lpad(c_custkey::VARCHAR, 5, '0') WHEN 1 THEN 'A0A' || lpad(c_custkey::VARCHAR, 7, '0') ELSE 'Q1B' || lpad(c_custkey::VARCHAR, 3, '7') END AS uid FROM customer) SELECT uid, regexp_full_match(uid, '[OPQ][0-9][A-Z0-9]{3}[0-9]') OR regexp_full_match(uid, '[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}') AS looks_valid FROM m",
    "alignment_graph": q(HITS, "SELECT a.id AS i, rank, b.id AS j, round(1 / (1 + s), 6) AS d FROM (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, 'v' || j) AS rank FROM (SELECT i, j, round(x, 4) AS s FROM lines)) JOIN names a ON a.name = i JOIN names b ON b.name = j WHERE rank <= 3"),
    "fasta_ranges": "SELECT 'doc_' || doc_id AS id, length(s) AS length, s AS sequence FROM (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM documents) WHERE length(s) >= 200 AND starts_with('doc_' || doc_id, 'doc_1')",
    "pdb_structures": f"""WITH {ITEMS}, s AS (SELECT substr(name, 6) AS n, regexp_replace(letters, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS sequence FROM items),
b AS (SELECT lpad(n, 4, '0') AS id, sequence, length(sequence) AS length, list_transform(range(1, length(sequence) + 1), lambda p: p * 37 % 100 + 0.25::DOUBLE) AS b FROM s)
SELECT id, sequence, length, round(list_avg(b), 6) AS mean_bfactor, round(len(list_filter(b, lambda x: x > 90)) / nullif(length, 0), 6) AS frac_high, round(len(list_filter(b, lambda x: x < 50)) / nullif(length, 0), 6) AS frac_low FROM b""",
    "blast_graph": q(HITS, "SELECT a.id AS i, rank, b.id AS j, round(1 / (1 + s), 6) AS d FROM (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, 'v' || j) AS rank FROM (SELECT i, j, round(x, 4) AS s FROM lines)) JOIN names a ON a.name = i JOIN names b ON b.name = j WHERE rank <= 3"),
    "alignment_ids": q(HITS, "SELECT id, 'v' || name AS name FROM names"),
    "selection_export": "SELECT c_custkey, c_name || ', \"the' || chr(9) || 'great\"' AS c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "isoelectric_point": q(
        f"""{SEQUENCES}, n AS MATERIALIZED (SELECT id, {", ".join(f"{count_of(r)}::DOUBLE AS n{r}" for r in (*ACIDIC, *BASIC))} FROM sq WHERE seq <> ''),
half(id, k, lo, hi) AS (SELECT id, 0, 0::DOUBLE, 14::DOUBLE FROM n UNION ALL SELECT id, k + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (SELECT half.*, (lo + hi) / 2 AS mid, {charge("((lo + hi) / 2)", lambda r: "n" + r)} > 0 AS up FROM half JOIN n USING (id) WHERE k < 100))""",
        "SELECT sq.id, round((lo + hi) / 2, 6) AS isoelectric_point FROM sq LEFT JOIN half ON half.id = sq.id AND k = 100",
    ),
    "knn_cosine": q(GRAPH, "SELECT i, rank, j, round(d, 6) AS d FROM g"),
    "knn_l2": q(f"{POINTS}, {neighbours('g', K, 'list_distance')}", "SELECT i, rank, j, round(d, 6) AS d FROM g"),
    "knn_external": q(f"{POINTS}, qs AS (SELECT * FROM e WHERE id % 20 = 0), {neighbours('g', K, left='qs', other='TRUE')}", "SELECT i, rank, j, round(d, 6) AS d FROM g"),
    "knn_from_matrix": q(f"{POINTS}, {neighbours('g', K, 'list_distance')}", "SELECT i, rank, j, round(d, 6) AS d FROM g"),
    "component_shelves": q(
        """b AS (SELECT o_custkey AS root, count(*) AS n, min(l_quantity) AS x0, min(l_linenumber)::DOUBLE AS y0, max(l_quantity) - min(l_quantity) + 1 AS w, (max(l_linenumber) - min(l_linenumber) + 1)::DOUBLE AS h
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
        lim AS (SELECT greatest(max(w), sqrt(sum(w * h))) AS lim FROM b),
        strip AS (SELECT *, sum(w) OVER (ORDER BY n DESC, root) - w AS spot FROM b),
        cut AS (SELECT *, floor(spot / lim)::BIGINT AS shelf FROM strip, lim),
        high AS (SELECT shelf, sum(max(h)) OVER (ORDER BY shelf) - max(h) AS y FROM cut GROUP BY shelf)""",
        "SELECT root, round(spot - shelf * lim - x0, 6) AS dx, round(y - y0, 6) AS dy FROM cut JOIN high USING (shelf)",
    ),
    "knn_jaccard_prefix": q(TOKENS + ",", jaccard("tok", "a.id % 20 = 0")),
    "knn_jaccard_tokens": q(TOKENS + ",", jaccard("tok", "a.id % 20 = 0")),
    "recall_at_k": q(f"{GRAPH}, {neighbours('h', K, 'list_distance')}", f"SELECT n, hits, round(hits::DOUBLE / (n * {K}), 6) AS recall FROM (SELECT count(DISTINCT i) AS n FROM g), (SELECT count(*) AS hits FROM g JOIN h USING (i, j))"),
    "neighbour_report": q(f"{POINTS}, qs AS (SELECT * FROM e WHERE id % 20 = 0), {neighbours('g', K, left='qs', other='TRUE')}", "SELECT i, string_agg(label::VARCHAR, ',' ORDER BY rank) AS labels, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM g JOIN e ON e.id = j GROUP BY i"),
    "minhash_signature": q(SIGNATURES, "SELECT id, p::BIGINT AS p, h FROM full_sig"),
    "signature_distances": q(SIGNATURES, f"SELECT b.id AS j, round(1 - len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2]))::DOUBLE / {PERMUTATIONS}, 6) AS d FROM sl a, sl b WHERE a.id = 0"),
    "lsh_bands": q(SIGNATURES, "SELECT band, count(*) AS buckets, max(n) AS largest FROM (SELECT band, h, count(*) AS n FROM band GROUP BY ALL) GROUP BY band"),
    "lsh_candidates": q(f"{SIGNATURES}, {CANDIDATES}", "SELECT i, j, first_band FROM cand"),
    "lsh_knn": q(f"{SIGNATURES}, {CANDIDATES},", signature_rank("i <> j")),
    "lsh_deepening": q(TOKENS, "SELECT count(DISTINCT id) AS n, true AS enough, true AS fewer FROM tok WHERE id % 20 = 0"),
    "lsh_recall": q(TOKENS, "SELECT count(DISTINCT id) AS n, true AS enough FROM tok WHERE id % 20 = 0"),
    "lsh_search": q(
        f"{SIGNATURES},",
        f"""place AS MATERIALIZED (SELECT id, p, h FROM sig), n AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
        cand AS MATERIALIZED (SELECT DISTINCT x.id AS i, y.id AS j FROM place x JOIN place y ON x.p = y.p AND x.h = y.h WHERE x.id % 20 = 0),
        met AS (SELECT x.id AS i, y.id AS j, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t WHERE x.id % 20 = 0 GROUP BY ALL),
        dist AS (SELECT i, j, 1 - c::DOUBLE / (a.n + b.n - c) AS d FROM met JOIN cand USING (i, j) JOIN n a ON a.id = i JOIN n b ON b.id = j)
        SELECT i, rank, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist) WHERE rank <= {K}""",
    ),
    "lsh_query": q(f"{SIGNATURES}, {CANDIDATES},", signature_rank("i % 20 = 0")),
    "knn_edges": q(EDGES, "SELECT u, v, round(w, 6) AS w FROM k"),
    "clean_edges": q(GRAPH, "SELECT least(i, j) AS u, greatest(i, j) AS v, round(min(d - 0.6), 6) AS w FROM g WHERE d - 0.6 >= 0 GROUP BY ALL"),
    "mst_edges": q(MST, "SELECT u, v, round(w, 6) AS w FROM mst"),
    "connected_components": q(f"{POINTS}, {neighbours('g', 1)}, s AS (SELECT i AS a, j AS b FROM g UNION SELECT j, i FROM g), reach(a, b) AS (SELECT id, id FROM e UNION SELECT reach.a, s.b FROM reach JOIN s ON s.a = reach.b)", "SELECT a AS node, min(b) AS root FROM reach GROUP BY a"),
    "component_count": q(f"{POINTS}, {neighbours('g', 1)}, k AS (SELECT least(i, j) AS u, greatest(i, j) AS v, min(d) AS w FROM g GROUP BY ALL), {kruskal()}", "SELECT nodes, edges, nodes - edges AS components FROM (SELECT count(*) AS nodes FROM e), (SELECT count(*) AS edges FROM mst)"),
    "degree_root": q(f"{MST}, {ROOT}", "SELECT node, degree FROM top"),
    "tree_bfs": q(TREE, "SELECT node, root, parent, depth::BIGINT AS depth, row_number() OVER (PARTITION BY root ORDER BY depth, path) - 1 AS bfs FROM rooted"),
    "tree_dfs": q(TREE, "SELECT node, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS dfs FROM rooted"),
    "subtree_sizes": q(f"{TREE}, {SIZES}", "SELECT node, size FROM sizes"),
    "tree_distances": q(f"{MST}, {spread('SELECT 0::BIGINT AS id')}", "SELECT id AS node, round(coalesce(dist, 'inf'::DOUBLE), 6) AS dist FROM e LEFT JOIN t ON t.node = id"),
    "signature_scan": q(SIGNATURES, f"SELECT 0::BIGINT AS i, rank, j, round(d, 6) AS d FROM (SELECT j, d, row_number() OVER (ORDER BY d, j) AS rank FROM (SELECT b.id AS j, 1 - len(list_filter(list_zip(a.s, b.s), lambda z: z[1] = z[2]))::DOUBLE / {PERMUTATIONS} AS d FROM sl a, sl b WHERE a.id = 0 AND b.id % 2 = 0)) WHERE rank <= 10"),
    "neighbour_ids": f"SELECT i, rank, j FROM ({q(f'{SIGNATURES}, {CANDIDATES},', signature_rank('i <> j'))})",
    "node_neighbours": q(MST, "SELECT b AS node, round(w, 6) AS w FROM s WHERE a = 3"),
    "tree_edge_weights": q(MST, "SELECT u, v, CASE WHEN u % 3 <> 0 THEN round(w, 6) ELSE 1.0::DOUBLE END AS w FROM mst"),
    "sql_tree_path": q(path_between(77, 11), "SELECT pos::BIGINT AS pos, node FROM way"),
    "sql_nearest": "SELECT o_custkey AS i, rank, o_orderkey AS j, round(o_totalprice, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "stream_neighbours": f"WITH {POINTS} SELECT i, rank, j, round(d, 6) AS d FROM (SELECT a.id AS i, b.id AS j, list_cosine_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON b.id < a.id) WHERE rank <= {K}",
    "tree_path": q(path_between(3, 77), "SELECT pos::BIGINT AS pos, node FROM way"),
    "pair_distances": q(f"{MST}, {WALKS}", "SELECT a.id AS a, b.id AS b, hops::BIGINT AS hops, round(coalesce(dist, 'inf'::DOUBLE), 6) AS dist FROM e a JOIN e b ON a.id % 20 = 0 LEFT JOIN walks ON src = a.id AND node = b.id"),
    "pair_paths": q(f"{MST}, {WALKS}", "SELECT src AS a, walks.node AS b, generate_subscripts(path, 1)::BIGINT - 1 AS pos, unnest(path) AS node FROM walks WHERE walks.node = src + 37"),
    "tree_ball": q(f"{MST}, {spread('SELECT 10::BIGINT AS id')}", "SELECT node, depth::BIGINT AS depth FROM t WHERE depth <= 4"),
    "pseudotime": q(f"{MST}, {spread('SELECT id FROM e ORDER BY x DESC, id LIMIT 1')}", "SELECT id AS node, round(coalesce(dist, 'inf'::DOUBLE), 6) AS dist FROM e LEFT JOIN t ON t.node = id"),
    "boundary_edges": q(f"{MST}, {LABELLED}", "SELECT u, v, round(w, 6) AS w, label_u::BIGINT AS label_u, label_v::BIGINT AS label_v FROM le WHERE label_u <> label_v"),
    "confusion_matrix": q(f"{MST}, {LABELLED}", "SELECT label_a::BIGINT AS label_a, label_b::BIGINT AS label_b, count(*) AS n FROM (SELECT label_u AS label_a, label_v AS label_b FROM le UNION ALL SELECT label_v, label_u FROM le) GROUP BY ALL"),
    "edge_delta": q(f"{MST}, {LABELLED}", "SELECT u, v, round(abs(x_u - x_v), 6) AS delta FROM le"),
    "path_properties": q(path_between(3, 77), "SELECT pos::BIGINT AS pos, node, round(x, 6) AS value FROM way JOIN e ON e.id = node"),
    "node_diversity": q(MST, "SELECT id AS node, round(coalesce(avg(w), 0), 6) AS mean, round(coalesce(max(w), 0), 6) AS max, round(coalesce(median(w), 0), 6) AS median FROM e LEFT JOIN s ON s.a = id GROUP BY id"),
    "subtree_purity": q(f"{TREE}, {SIZES}, {PURITY}", "SELECT node, size, round(purity, 6) AS purity FROM pure"),
    "boundary_rate": q(f"{MST}, {LABELLED}", "SELECT count(*) AS edges, count(*) FILTER (label_u <> label_v) AS boundary, round(avg((label_u <> label_v)::INT), 6) AS rate FROM le"),
    "purity_summary": q(f"{TREE}, {SIZES}, {PURITY}", "SELECT round(avg(purity), 6) AS mean, round(median(purity), 6) AS median, round(min(purity), 6) AS least, count(purity) AS n FROM pure"),
    "top_label_pairs": q(f"{MST}, {LABELLED}", "SELECT least(label_u, label_v)::BIGINT AS label_a, greatest(label_u, label_v)::BIGINT AS label_b, count(*) AS n FROM le WHERE label_u <> label_v GROUP BY ALL ORDER BY n DESC, label_a, label_b LIMIT 10"),
    "label_route": q(f"{MST}, {spread('SELECT min(id) AS id FROM e WHERE label = 0')}, way AS (SELECT unnest(path) AS node, generate_subscripts(path, 1) - 1 AS pos FROM t WHERE node = (SELECT min(id) FROM e WHERE label = 7))", "SELECT pos::BIGINT AS pos, node, label::BIGINT AS label FROM (SELECT pos, node, label, lag(label) OVER (ORDER BY pos) AS before FROM way JOIN e ON e.id = node) WHERE before IS NULL OR before <> label"),
    "label_coherence": q(f"{MST}, {LABELLED}", "SELECT label::BIGINT AS label, count(*) FILTER (label_u = label_v) AS internal, count(*) FILTER (label_u <> label_v) AS boundary, round(count(*) FILTER (label_u <> label_v)::DOUBLE / count(*), 6) AS share FROM (SELECT *, unnest(list_distinct([label_u, label_v])) AS label FROM le) GROUP BY label"),
    "steep_edges": q(f"{MST}, {LABELLED}", "SELECT u, v, round(abs(x_u - x_v), 6) AS delta FROM le WHERE abs(x_u - x_v) > (SELECT quantile_cont(abs(x_u - x_v), 0.99) FROM le)"),
    "mislabelled": q(f"{POINTS}, {neighbours('g', 1)}", "SELECT i AS id, a.label::BIGINT AS label, b.label::BIGINT AS predicted, round(1 - d, 6) AS confidence FROM g JOIN e a ON a.id = i JOIN e b ON b.id = j WHERE a.label <> b.label ORDER BY 1 - d DESC, i LIMIT 10"),
    "transform_positions": q(
        f"{POINTS}, old AS (SELECT * FROM e WHERE id % 10 <> 9), new AS (SELECT * FROM e WHERE id % 10 = 9), {neighbours('g', K, left='new', right='old', other='TRUE')}, {neighbours('o', 1, left='old', right='old')},"
        " sc AS (SELECT CASE WHEN m > 0 THEN m ELSE 1 END AS s FROM (SELECT median(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM o JOIN e a ON a.id = i JOIN e b ON b.id = j)),"
        " f AS (SELECT i, x AS px, y AS py FROM g JOIN e ON e.id = j WHERE rank = 1), m AS (SELECT i, avg(x) AS mx, avg(y) AS my FROM g JOIN e ON e.id = j WHERE rank > 1 GROUP BY i)",
        "SELECT i AS id, round(px + 0.3 * s * (mx - px) / sqrt(pow(mx - px, 2) + pow(my - py, 2)), 6) AS x, round(py + 0.3 * s * (my - py) / sqrt(pow(mx - px, 2) + pow(my - py, 2)), 6) AS y FROM f JOIN m USING (i), sc",
    ),
    "normalize_coords": q(NORMAL, "SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM nm"),
    "normalize_axes": q(f"{POINTS}, {RANGE}", "SELECT id, round((x - x0) / (x1 - x0) - 0.5, 6) AS x, round((y - y0) / (y1 - y0) - 0.5, 6) AS y FROM e, r"),
    "quantize_coords": q(f"{NORMAL}, qc AS (SELECT id, floor((round(x, 6) + 1) * 32767.5)::BIGINT AS qx, floor((round(y, 6) + 1) * 32767.5)::BIGINT AS qy FROM nm)", "SELECT id, qx, qy, round(qx * 2.0 / 65535 - 1, 6) AS x, round(qy * 2.0 / 65535 - 1, 6) AS y FROM qc"),
    "colour_positions": "SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 6) AS position FROM events",
    "category_codes": "WITH d AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY 1) SELECT c_custkey, c_mktsegment, code AS c_mktsegment_code FROM customer JOIN d USING (c_mktsegment)",
    "value_histogram": "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM events, r GROUP BY 1",
    "facet_top": "WITH n AS (SELECT source AS value, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS r FROM n) SELECT CASE WHEN r <= 15 THEN value ELSE '__other__' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1",
    "facet_recount": "WITH n AS (SELECT source AS value, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IN ('de', 'fr') AND n_chars BETWEEN 100 AND 2000 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS r FROM n) SELECT CASE WHEN r <= 15 THEN value ELSE '__other__' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1",
    "other_filter": "WITH n AS (SELECT c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 1), top AS (SELECT value FROM n ORDER BY n DESC, value LIMIT 15) SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_nationkey = 3 OR c_nationkey::VARCHAR NOT IN (SELECT value FROM top)",
    "range_filter": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 30000",
    "text_search": "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license')",
    "row_subset": "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "sample_quotas": "WITH n AS (SELECT event_type, count(*) AS n, count(*) OVER () AS g, row_number() OVER (ORDER BY event_type) AS r FROM events GROUP BY event_type) SELECT event_type, 500 // g + (r <= 500 % g)::BIGINT AS n FROM n",
    "text_numbers": r"SELECT c_custkey, round(try_cast(regexp_replace(c_name, '[^0-9.\-]', '', 'g') AS DOUBLE), 6) AS number, try_cast(regexp_replace(c_mktsegment, '[^0-9.\-]', '', 'g') AS DOUBLE) AS none FROM customer",
    "cell_metadata": "SELECT c_custkey, c_nationkey::DOUBLE AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "marker_scores": "SELECT o_orderkey AS cell, round(coalesce(sum(l_quantity) FILTER (l_suppkey IN (1, 2, 3, 4)), 0) / 4, 6) AS score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "item_set_jaccard": q("tok AS MATERIALIZED (SELECT DISTINCT o_custkey AS id, l_partkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),", jaccard("tok", "a.id % 20 = 0")),
    "sequence_properties": q(SEQUENCES, "SELECT id, " + ", ".join(f"CASE WHEN seq <> '' THEN round({f}, 6) END AS {p}" for p, f in PROPERTIES.items()) + " FROM sq"),
    "kmer_features": "WITH b AS (SELECT item_id AS id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM benchmark), k AS (SELECT id, seq[i : i + 2] AS kmer, length(seq) - 2 AS total FROM b, range(1, 100000) r(i) WHERE i <= length(seq) - 2) SELECT id, kmer, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS frequency FROM k GROUP BY id, kmer",
}
# What was saved and loaded gives the rows of what wasn't
ORACLE_SQL |= {saved: ORACLE_SQL[plain] for saved, plain in (("saved_signatures", "lsh_query"), ("saved_index", "index_additions"), ("saved_model", "kneighbors"))}
