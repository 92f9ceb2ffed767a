"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[^\x20\x09-\x0D]+"


def alnum_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"


SPACE_WORDS = f"w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws FROM documents)"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {alnum_words("text")} AS ws FROM documents),
b AS MATERIALIZED (SELECT item_id, row_number() OVER () AS rid, {alnum_words("text")} AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[k : k + 7], ' ') AS g FROM b, range(1, 100000) r(k) WHERE len(ws) > 0 AND k <= greatest(1, len(ws) - 7)),
sizes AS (SELECT DISTINCT n FROM win),
hits AS MATERIALIZED (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d), sizes WHERE p + n - 1 <= len(ws)) JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
bt AS (SELECT DISTINCT item_id, rid, unnest(ws) AS t FROM b),
rare AS MATERIALIZED (SELECT item_id, rid, t, r FROM (SELECT item_id, rid, t, row_number() OVER (PARTITION BY rid ORDER BY n, t) AS r, count(*) OVER (PARTITION BY rid) AS c FROM bt JOIN (SELECT t, count(*) AS n FROM bt GROUP BY t) USING (t)) WHERE r <= 4 AND c >= 4),
pos AS MATERIALIZED (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS p FROM d) WHERE t IN (SELECT t FROM rare)),
beside AS (SELECT DISTINCT x.doc_id, f.item_id FROM rare f JOIN pos x ON f.r = 1 AND x.t = f.t JOIN rare o ON o.rid = f.rid AND o.r > 1 JOIN pos y ON y.doc_id = x.doc_id AND y.t = o.t AND y.p BETWEEN x.p - 10 AND x.p + 10 GROUP BY f.rid, f.item_id, x.doc_id, x.p HAVING count(DISTINCT o.r) = 3),
near AS (SELECT doc_id, count(*) AS n_near FROM beside GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

SUBSTRINGS = f"""
WITH {SPACE_WORDS},
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
later AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM later)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS left_over FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w) a ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUALITY = rf"""
WITH {SPACE_WORDS},
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\x20\t]*[*•‣-]\x20')) AS n_bulleted, count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\t\r]*$')) AS n_cut_off FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
common AS (SELECT doc_id, max(c) AS top_word, sum(c) FILTER (regexp_matches(word, '\p{{L}}')) AS n_lettered FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_bulleted, 0) AS n_bulleted, coalesce(n_cut_off, 0) AS n_cut_off, coalesce(top_word, 0) AS top_word, coalesce(n_lettered, 0) AS n_lettered FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN common USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR word_chars NOT BETWEEN 2 * n_words AND 25 * n_words OR 2 * n_dup_lines > n_lines
  OR 2 * n_lettered < n_words OR 10 * n_bulleted > 9 * n_lines OR 10 * n_cut_off > 3 * n_lines OR 10 * top_word > 3 * n_words) AS kept FROM f"""

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_quality_rules": QUALITY,
}

#: crc32 (polynomial 0xEDB88320, reflected) of a number's decimal digits, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, base: str) -> str:
    """Levels of the trees ``base (tree, pos, digest)``: nodes with their run's other digests to the left and right."""
    return f"""{name}_up AS (SELECT 0 AS level, tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {base}
  UNION ALL SELECT level + 1, tree, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM {name}_up WHERE n > 1 GROUP BY level, tree, pos // 8),
{name} AS MATERIALIZED (SELECT a.level, a.tree, a.pos, any_value(a.digest) AS digest, any_value(a.n) AS n,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}_up a JOIN {name}_up b ON a.level = b.level AND a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.level, a.tree, a.pos)"""


MANIFEST = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf,
  CASE WHEN {CRC32} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS claimed FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
leaves AS (SELECT tree, pos, leaf AS digest FROM p),
{_tree("low", "leaves")},
subs AS MATERIALIZED (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM low WHERE n = 1),
tops AS (SELECT '' AS tree, pos, subroot AS digest FROM subs),
{_tree("high", "tops")},
root AS (SELECT digest AS root FROM high WHERE n = 1),
steps AS MATERIALIZED (SELECT rid, level AS step, l, r FROM p JOIN low ON low.tree = p.tree AND low.pos = p.pos // power(8, level)::BIGINT WHERE n > 1
  UNION ALL SELECT rid, 100 + level, l, r FROM p JOIN subs ON subs.name = p.tree JOIN high ON high.pos = subs.pos // power(8, level)::BIGINT WHERE n > 1),
numbered AS MATERIALIZED (SELECT rid, l, r, row_number() OVER (PARTITION BY rid ORDER BY step) AS k FROM steps),
folds AS (SELECT rid, 0::BIGINT AS k, claimed AS digest FROM p UNION ALL SELECT f.rid, f.k + 1, sha256(l || f.digest || r) FROM folds f JOIN numbered s ON s.rid = f.rid AND s.k = f.k + 1),
ends AS (SELECT rid, max_by(digest, k) AS folded_root FROM folds GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM numbered GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN subs ON subs.name = p.tree JOIN ends USING (rid) LEFT JOIN proofs USING (rid) CROSS JOIN root"""

AUDIT = rf"""
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
told AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws FROM documents),
f AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w JOIN first USING (t) LEFT JOIN told ON told.doc_id = w.doc_id),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS k, filter_order[1 : i - 1] AS earlier FROM orders, range(1, 6) r(i)),
each AS (SELECT part, filter_order, step, k, n, g, x, contains(fails, k) AS bad, len(translate(fails, earlier, '')) < len(fails) AS gone, fails = k AS alone FROM s, c),
steps AS MATERIALIZED (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM steps"""

ORACLE_SQL |= {"op12_merkle_manifest": MANIFEST, "op13_filter_audit": AUDIT}
