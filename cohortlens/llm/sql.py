"""Check SQL (DuckDB) of the package's queries, where SQL can express them."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[pos:pos + k - 1], ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT doc_id, item_id, pos, k FROM places JOIN windows USING (k, words)
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

TOPK = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
) WHERE rank <= 20
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), firsts AS (
  SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h
)
SELECT p.page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN firsts f USING (h)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

# a run's smallest period: stretches that keep several periods are equal for all of them
PERIODIC_RUNS = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295) AS h
  FROM documents
), changed AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS k FROM hashed
), words AS (
  SELECT doc_id, n, CASE WHEN again THEN
    [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + k)) + 1] END FOR i IN range(n)] ELSE w END AS w
  FROM changed
), placed AS (
  SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM words
), kept_apart AS (
  SELECT a.doc_id, b.i - a.i AS period, a.i, a.n FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.word = b.word
    AND b.i > a.i AND (b.i - a.i) * 4 <= a.n
), stretches AS (
  SELECT doc_id, period, min(i) AS start, count(*) + period AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS same FROM kept_apart)
  GROUP BY doc_id, period, same HAVING count(*) + period >= greatest(6, 4 * period)
), runs AS (
  SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (FROM runs b WHERE b.doc_id = a.doc_id AND (b.length * a.period > a.length * b.period
    OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period)))
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM placed ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""

SQL: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION, "op5_topk": TOPK, "op6_warc": WARC, "op11_hard_negatives": HARD_NEGATIVES,
    "op13_periodic_runs": PERIODIC_RUNS,
}
