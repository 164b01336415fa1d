"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .decontaminate import BETWEEN
from .quality import CHAR_LIMIT, COMMON, MIN_CHARS, MIN_COMMON, MIN_DOCS, MIN_WORDS, SPACE, WORD_LIMIT

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({LOWERED}, '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({LOWERED}, '{BETWEEN}'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quality() -> str:
    classes = ["[a-z]+", SPACE + "+", "[A-Z]+", "[0-9]+", "[.,;:!?''\"()-]+", r"[\x00-\x7F]+"]
    rest, lengths = "t", ["length(t)"]
    for c in classes:
        rest = f"regexp_replace({rest}, '{c}', '', 'g')"
        lengths.append(f"length({rest})")
    counts = ", ".join(f"{a} - {b}" for a, b in zip(lengths, lengths[1:])) + f", {lengths[-1]}"
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    share = lambda a: f"CASE WHEN list_sum({a}) > 0 THEN list_transform({a}, lambda x: x / CAST(list_sum({a}) AS DOUBLE)) END"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    apart = lambda p, q: f"coalesce(sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part('z[1]')} + {part('z[2]')}) / 2)))), 0)"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '')) AS w FROM d WHERE lang IS NOT NULL) GROUP BY lang, w),
lists AS (SELECT lang, list(w ORDER BY k) AS l, list(n ORDER BY k) AS ln FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM v) WHERE k <= {COMMON} GROUP BY lang),
c AS (SELECT d.*, [{counts}] AS ch, CASE WHEN l IS NOT NULL THEN list_transform(l, lambda c: len(list_filter(w, lambda x: x = c))) END AS cw FROM d LEFT JOIN lists USING (lang)),
e AS (SELECT *, CASE WHEN cw IS NOT NULL THEN list_append(cw, len(w) - CAST(list_sum(cw) AS BIGINT)) END AS co FROM c),
q AS (SELECT lang, count(*) AS n, {sums('ch', 7)} AS rc, sum(len(w)) AS nw FROM e GROUP BY lang),
r AS (SELECT q.lang, n, rc, CASE WHEN ln IS NOT NULL THEN list_append(ln, CAST(nw - list_sum(ln) AS BIGINT)) END AS rw FROM q LEFT JOIN lists ON lists.lang = q.lang),
a AS (SELECT {sums('rc', 7)} AS ac FROM r),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT e.*, coalesce(rep.n, 0) AS nr, CASE WHEN r.n >= {MIN_DOCS} THEN rc ELSE ac END AS qc, CASE WHEN r.n >= {MIN_DOCS} THEN rw END AS qw FROM e LEFT JOIN rep USING (doc_id) LEFT JOIN r ON r.lang = e.lang CROSS JOIN a),
g AS (SELECT *, {share('ch')} AS pch, {share('qc')} AS pqc, {share('co')} AS pco, {share('qw')} AS pqw, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM f),
h AS (SELECT *, len(w) < 10 OR 100 * nr > 20 * len(w) AS failed, CASE WHEN len(w) >= {MIN_WORDS} AND length(t) >= {MIN_CHARS} THEN {apart('pch', 'pqc')} END AS cd, CASE WHEN len(w) >= {MIN_COMMON} AND length(t) >= {MIN_CHARS} THEN {apart('pco', 'pqw')} END AS wd FROM g)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(nr AS BIGINT) AS n_repeat_words, failed AS base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
 NOT failed AND coalesce(cd, 0) <= {CHAR_LIMIT} AND coalesce(wd, 0) <= {WORD_LIMIT} AS kept FROM h"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS s FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.s AS ps, s.b AS nb, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS every FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS own FROM f GROUP BY ALL),
p AS (SELECT f.*, 1 + (1000000000 * (n + 5)) // (own + 5 * v) AS p, 1 + (1000000000 * (total + 5)) // (every + 5 * v) AS q FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50"""


ORACLES = {"op12_source_divergence": DIVERGENCE, "op11_hard_negatives": NEGATIVES, "op7_decontaminate": DECONTAMINATION, "op9_quality_rules": _quality()}
