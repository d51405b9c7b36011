"""DuckDB statements that say the same as queries of this folder, from the definitions."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, {_PLAIN}) AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, {_PLAIN}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, g, len(string_split(g, ' ')) AS s FROM (
  SELECT item, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0) x) y),
dw AS (SELECT rid, s, i, array_to_string(w[i:i + s - 1], ' ') AS g
       FROM (SELECT rid, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM win) z) x),
hit AS (SELECT DISTINCT rid, dw.s, i, item FROM dw JOIN win USING (g)),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + s)) AS p FROM hit) x GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)"""

HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, id, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.s DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.s DESC, s.id) <= 10"""

_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT) for z in range(8)], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

PERIODIC_RUNS = rf"""WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d1 AS (SELECT *, len(w) AS n, {_CRC} AS h FROM d0),
d2 AS (SELECT *, (h // 10) % n AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d2),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM d3),
grams AS (SELECT rid, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT rid, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 6) x),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.g = y.g AND x.i < y.i),
stretch AS (SELECT rid, q, min(i) AS start, count(*) + q + 4 AS length FROM (
  SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pairs) x GROUP BY rid, q, k),
runs AS (SELECT rid, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length),
top AS (SELECT rid, start, length, period FROM runs
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(n)) AS i FROM d) x ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)"""
