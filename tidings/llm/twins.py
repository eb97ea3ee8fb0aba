"""DuckDB SQL for the queries that SQL can express, from their contracts."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH item_words AS (
  SELECT item_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[a:a + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM item_words WHERE len(ws) > 0), range(1, len(ws) - n + 2) r(a)),
doc_windows AS (
  SELECT doc_id, n, a, array_to_string(ws[a:a + n - 1], ' ') AS w
  FROM doc_words, (SELECT DISTINCT n FROM item_windows), range(1, len(ws) - n + 2) r(a)),
hits AS (SELECT doc_id, item_id, n, a FROM doc_windows JOIN item_windows USING (n, w)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, range(a, a + n) r(p) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

OP8 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[a:a + 4], ' ') AS s
  FROM doc_words, range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END) r(a)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

OP12 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM vectors a, vectors v WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""

OP13 = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (
  SELECT doc_id, a, array_to_string(ws[a:a + 19], ' ') AS w FROM doc_words, range(1, len(ws) - 18) r(a)),
later AS (
  SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, range(a, a + 20) r(p)),
kept AS (
  SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS words
  FROM doc_words, range(1, len(ws) + 1) r(p) WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM doc_words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

def _tree(leaves: str, name: str, levels: int) -> str:
    """Levels ``name``0, ``name``1, ... of all trees in ``leaves`` (tree, place, n, digest), with both sides of each node."""
    sql = f"{name}0 AS (SELECT * FROM {leaves})"
    for j in range(levels):
        sql += f""",
{name}{j}_side AS (
  SELECT tree, place, n, digest, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{j} WHERE n > 1 WINDOW w AS (PARTITION BY tree, place // 8 ORDER BY place)),
{name}{j + 1} AS (
  SELECT tree, place // 8 AS place, (n + 7) // 8 AS n, sha256(l || digest || r) AS digest FROM {name}{j}_side WHERE place % 8 = 0
  UNION ALL SELECT * FROM {name}{j} WHERE n = 1)"""
    return sql


#: levels of the trees: enough for 8 ** 9 documents of a language and 8 ** 4 languages
LOW, HIGH = 9, 4


def _op11() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    steps = [f"low{j}_side" for j in range(LOW)], [f"high{j}_side" for j in range(HIGH)]
    joins, sides = "", []
    for j, t in enumerate(steps[0]):
        joins += f"\n  LEFT JOIN {t} a{j} ON a{j}.tree = leaves.tree AND a{j}.place = leaves.place // {8 ** j} AND leaves.n > {8 ** j}"
        sides.append((f"coalesce(a{j}.l, '')", f"coalesce(a{j}.r, '')", f"a{j}.tree IS NOT NULL"))
    for j, t in enumerate(steps[1]):
        joins += f"\n  LEFT JOIN {t} b{j} ON b{j}.place = groups.place // {8 ** j} AND groups.n > {8 ** j}"
        sides.append((f"coalesce(b{j}.l, '')", f"coalesce(b{j}.r, '')", f"b{j}.tree IS NOT NULL"))
    proof = " || ".join(f"{l} || {r}" for l, r, _ in sides)
    folds = "".join(f""",
fold{k + 1} AS (SELECT * REPLACE (CASE WHEN t{k} THEN sha256(l{k} || d || r{k}) ELSE d END AS d) FROM fold{k})"""
                    for k in range(len(sides)))
    lists = ", ".join(f"{l} AS l{k}, {r} AS r{k}, {t} AS t{k}" for k, (l, r, t) in enumerate(sides))
    return rf"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS p, 4294967295 AS c FROM documents
  UNION ALL SELECT doc_id, s, p + 1, xor(crc.c >> 8, bits.c) FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c & 255, ascii(s[p + 1]))
  WHERE p < length(s)),
ids AS (SELECT doc_id, xor(c, 4294967295) % 3 = 0 AS tampered FROM crc WHERE p = length(s)),
rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {field("text")}) AS digest,
         CASE WHEN tampered THEN sha256({head} || {field(LOWER)}) END AS claimed
  FROM documents LEFT JOIN ids USING (doc_id)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM rows),
{_tree("(SELECT tree, place, n, digest FROM leaves)", "low", LOW)},
groups AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest, tree AS lang FROM low{LOW}),
{_tree("(SELECT tree, place, n, digest FROM groups)", "high", HIGH)},
fold0 AS (
  SELECT leaves.doc_id, leaves.digest AS leaf, groups.digest AS subroot, (SELECT digest FROM high{HIGH}) AS root,
         sha256({proof}) AS proof_sha256, coalesce(claimed, leaves.digest) AS d, {lists}
  FROM leaves JOIN groups ON groups.lang = leaves.tree{joins}){folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, d AS folded_root, d = root AS verified FROM fold{len(sides)}"""


SQL: dict[str, str] = {"op1_decontaminate": OP1, "op8_jaccard": OP8, "op11_merkle": _op11(),
                       "op12_negatives": OP12, "op13_substring": OP13}
