"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SEED_AND_EXTEND = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d) x),
hit AS (SELECT rid, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM hit) x),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS k FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) y ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS c FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)"""

FM_INDEX = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
want AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT size FROM want),
win AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size) x),
hit AS (SELECT win.rid, win.i, win.size, want.item FROM win JOIN want ON win.size = want.size AND win.k = want.k),
cover AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) x GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d) x),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.rid <> y.rid GROUP BY 1, 2) p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id"""

#: CRC-32 of an expression's bytes; crc_table() of the 256 steps is a row named crc with a list named steps.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"


def _crc32(text: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


PREFIX_TRIE = rf"""
WITH {_CRC_TABLE},
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, p, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc),
built AS (SELECT c.conv_id, list_concat(coalesce(b.p[1:c.h], []), c.p[c.h + 1:]) AS p FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
pre AS (SELECT conv_id, p[1:d] AS k, d, d = len(p) AS ends FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM built) x),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(k[d].text)) END AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS s FROM pre GROUP BY k, d),
up AS (SELECT c.*, u.conv_id AS parent FROM node c LEFT JOIN node u ON u.d = c.d - 1 AND u.k = c.k[1:c.d - 1]),
kids AS (SELECT d - 1 AS d, parent, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
whole AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.d = up.d AND kids.parent = up.conv_id),
below AS (SELECT k[1:e] AS k, sum(CAST(n_children = 0 AS BIGINT)) AS leaves, sum((n - 1) * bytes) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM whole) x GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, s AS ends_sha256
FROM whole JOIN below USING (k)"""

RESAMPLING = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
f AS (SELECT rid, unnest(w) AS x FROM d),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS x FROM benchmark),
words AS (SELECT x, {_crc32("x")} % 10000 AS bucket FROM (SELECT x FROM f UNION SELECT x FROM b) u, crc),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM f JOIN words USING (x) GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM b JOIN words USING (x) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT rid, sum(gain) AS weight FROM f JOIN words USING (x) JOIN gains USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (rid)),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM placed) THEN CAST(place AS BIGINT) END AS rank FROM scored LEFT JOIN placed USING (rid)"""

ORACLE_SQL = {"op7_seed_and_extend": SEED_AND_EXTEND, "op8_fm_index": FM_INDEX, "op9_ngram_jaccard_join": JACCARD_JOIN, "op12_prefix_trie": PREFIX_TRIE, "op13_importance_resampling": RESAMPLING}
