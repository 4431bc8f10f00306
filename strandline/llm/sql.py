"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || md5(coalesce('s' || doc_id::VARCHAR, 'n')) || md5(coalesce('s' || text, 'n'))) AS key
  FROM documents),
src AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w FROM src),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighted),
run AS (
  SELECT *, row_number() OVER o AS rank,
         (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY cap / w, skey)),
targets AS (
  SELECT skey, source_size,
         CASE WHEN level >= cap / w OR f IS NULL THEN cap ELSE least(cap, f * w) END AS target
  FROM (SELECT *, (SELECT arg_min(level, rank) FROM run WHERE level < cap / w) AS f FROM run)),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t USING (skey))
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - prior)))::BIGINT AS taken
FROM placed
"""

OP4 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 50)))) AS g
  FROM win JOIN first USING (h) WHERE d < doc_id GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_filter(ws, lambda x, j: NOT list_contains(g, j)), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(list_slice(ws, i, i + 9), ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM items),
win AS (
  SELECT r, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS k
  FROM (SELECT r, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m)),
hits AS (SELECT r, win.m, i, item_id FROM win JOIN items ON win.k = items.k AND win.m = items.m),
per AS (
  SELECT r, len(list_distinct(flatten(list(range(i, i + m))))) AS n_hit, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r)
"""

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM t
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1, "op4_substring_dedup": OP4, "op6_decontamination": OP6, "op7_warc": OP7}
