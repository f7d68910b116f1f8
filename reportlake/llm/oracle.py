"""SQL for DuckDB of the operators whose results SQL can express, by their plain definitions."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything reachable over ``links(a, b)``, then the smallest of it.
_REACH = """reach AS (
  SELECT DISTINCT a AS v, a AS u FROM links
  UNION
  SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.u
),
named AS (SELECT v, min(u) AS component FROM reach GROUP BY v)"""

EARLIER = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents
),
windows AS (SELECT r, d, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, d, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p FROM docs)),
covered AS (SELECT r, p FROM (SELECT r, d, p, min(d) OVER (PARTITION BY s) AS one FROM windows) WHERE one < d),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM covered),
opens AS (SELECT r, count(*) AS removed, count(*) FILTER (before IS NULL OR before <> p - 1) AS spans
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM gone) GROUP BY r),
bytes AS (SELECT r, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p FROM docs)),
kept AS (SELECT b.r, string_agg(b.b, '' ORDER BY b.p) AS h FROM bytes b ANTI JOIN gone g ON g.r = b.r AND g.p = b.p GROUP BY b.r)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(o.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(o.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN opens o ON o.r = d.r LEFT JOIN kept k ON k.r = d.r
"""

NEAR = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents
),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END AS s FROM docs
),
cells AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, a.r AS ra, b.r AS rb, count(*) AS i
  FROM cells a JOIN cells b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
links AS (SELECT DISTINCT a, b FROM common WHERE 100 * i >= 75 * (na + nb - i)),
{_REACH}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(n.component, s.doc_id) AS component_id,
  s.doc_id IS NULL OR coalesce(n.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN named n ON n.v = s.doc_id
"""

REPEATED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM docs WHERE len(w) >= 35),
hashed AS (SELECT r, p, sha256(array_to_string(w[p : p + 34], ' ')) AS h FROM windows),
many AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM hashed) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM many),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.p) AS t FROM words w ANTI JOIN gone g ON g.r = w.r AND g.p = w.p GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g ON g.r = d.r LEFT JOIN kept k ON k.r = d.r
"""

VECTORS = f"""
WITH RECURSIVE all_rows AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT r, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM all_rows
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
near AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98),
links AS (SELECT DISTINCT a, b FROM near),
{_REACH},
counts AS (SELECT r, count(*) AS n FROM near GROUP BY r)
SELECT x.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, CASE WHEN c.n > 0 THEN n.component ELSE x.vec_id END AS component_id,
  x.vec_id IS NULL OR c.n IS NULL OR n.component = x.vec_id AS kept
FROM all_rows x LEFT JOIN counts c ON c.r = x.r LEFT JOIN named n ON n.v = x.vec_id
"""

ORACLE_SQL = {"op6_suffix_dedup": EARLIER, "op7_near_duplicates": NEAR, "op8_repeated_windows": REPEATED, "op9_near_vectors": VECTORS}
