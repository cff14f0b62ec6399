"""SQL (DuckDB) for the queries that it can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS g FROM d
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * both_have >= 90 * (na.n + nb.n - both_have)
), walk AS (
  SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, v FROM reach r JOIN walk ON r.other = u
), marks AS (
  SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS copies FROM (SELECT d.doc_id, md5(coalesce(string_agg(g, chr(10) ORDER BY g), 'none' || d.doc_id)) AS g FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id)
), linked AS (
  SELECT u AS doc_id, count(DISTINCT b.g) AS n_links FROM walk JOIN marks a ON u = a.doc_id JOIN marks b ON v = b.doc_id WHERE a.g <> b.g GROUP BY u
)
SELECT doc_id, n AS n_shingles, component_id, copies, coalesce(n_links, 0) AS n_links FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id) JOIN marks USING (doc_id) LEFT JOIN linked USING (doc_id)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS wide FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, wide, w[i:i + wide - 1] AS k FROM (SELECT item_id, w, wide, unnest(range(1, len(w) - wide + 2)) AS i FROM b)
), numbered AS (
  SELECT k, wide, row_number() OVER () AS wid FROM (SELECT DISTINCT k, wide FROM wins)
), terms AS (
  SELECT wid, wide, unnest(range(0, wide)) AS off, unnest(k) AS t FROM numbered
), tokens AS (
  SELECT rid, unnest(range(0, len(w))) AS pos, unnest(w) AS t FROM d
), whole AS (
  SELECT rid, wid FROM (SELECT DISTINCT rid, t FROM tokens) JOIN (SELECT DISTINCT wid, t FROM terms) USING (t) JOIN (SELECT wid, count(DISTINCT t) AS n FROM terms GROUP BY wid) USING (wid) GROUP BY rid, wid, n HAVING count(*) = n
), placed AS (
  SELECT rid, wid, wide, off, pos - off AS p FROM whole JOIN terms USING (wid) JOIN tokens USING (rid, t)
), exact AS (
  SELECT rid, wid, wide, p FROM placed GROUP BY ALL HAVING count(DISTINCT off) = wide
), near AS (
  SELECT rid, wid, wide, p FROM (SELECT rid, wid, wide, off, unnest([p - 1, p, p + 1]) AS p FROM placed) GROUP BY ALL HAVING count(DISTINCT off) = wide
), words AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + wide)) AS q FROM exact) GROUP BY rid
), near_words AS (
  SELECT rid, count(DISTINCT q) AS n_near_words FROM (SELECT rid, unnest(range(p, p + wide)) AS q FROM near) JOIN d USING (rid) WHERE q BETWEEN 0 AND len(w) - 1 GROUP BY rid
), exact_items AS (
  SELECT DISTINCT rid, item_id FROM exact JOIN numbered USING (wid) JOIN wins USING (k)
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM exact_items GROUP BY rid
), near_items AS (
  SELECT rid, count(*) AS n_near FROM (SELECT rid, item_id FROM near JOIN numbered USING (wid) JOIN wins USING (k) EXCEPT SELECT rid, item_id FROM exact_items) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(n_near_words, 0) AS n_near_words
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near_items USING (rid) LEFT JOIN near_words USING (rid)
"""
