"""DuckDB statements of those operators that SQL can say, written without the library's own code."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, min(doc_id) OVER (PARTITION BY md5(string_agg(g, chr(10) ORDER BY g))) AS class_id FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, coalesce(n.class_id, d.doc_id) AS class_id,
  coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) k USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (
  SELECT doc_id, i, words[i] AS word, CASE WHEN i + 12 <= len(words) THEN array_to_string(list_slice(words, i, i + 12), ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM t),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""

OP7 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP3 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, first, substr(h, 2 * first + 1, 1822) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 512)) AS first FROM d)),
b AS (SELECT doc_id, first, part, unnest(range(least(512, len(part) // 2))) AS k FROM p),
g AS (SELECT doc_id, first + k AS i, substr(part, 2 * k + 1, 2) AS byte, CASE WHEN 2 * k + 800 <= len(part) THEN md5(substr(part, 2 * k + 1, 800)) END AS g FROM b),
f AS (SELECT doc_id, i, byte, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM g),
c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE weights AS (
  SELECT 'src0' AS s, 19 AS w UNION ALL SELECT 'src' || i, 3 FROM range(1, 20) t(i) UNION ALL SELECT '(rest)', 3),
block AS (
  SELECT s, w, j, j * 79 // w AS release, printf('%05d %05d %s %02d', ((j + 1) * 79 + w - 1) // w, w, s, j) AS due
  FROM (SELECT s, w, unnest(range(w)) AS j FROM weights)),
edf AS (
  SELECT 0 AS slot, CAST([] AS VARCHAR[]) AS placed
  UNION ALL
  SELECT slot + 1, list_append(placed, min(due)) FROM edf JOIN block ON release <= slot AND NOT list_contains(placed, due)
  WHERE slot < 79 GROUP BY slot, placed),
period AS (SELECT unnest(placed) AS due, unnest(range(79)) AS place FROM edf WHERE slot = 79),
slots AS (SELECT s, w, j, place FROM block JOIN period USING (due)),
d AS (SELECT doc_id, source, coalesce(s, '(rest)') AS s FROM documents LEFT JOIN weights ON s = source AND s <> '(rest)'),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS k FROM d)
SELECT doc_id, source, n.s AS mix_class, k // 8 AS mix_block, (k // 8) * 79 // w AS mix_release, ((k // 8 + 1) * 79 + w - 1) // w AS mix_deadline,
  CAST(k // 8 // w * 79 + place AS BIGINT) AS mix_slot, CAST((k // 8 // w * 79 + place) * 8 + k % 8 AS BIGINT) AS mix_position
FROM n JOIN slots ON slots.s = n.s AND j = k // 8 % w
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard": OP1, "op2_substring_dedup": OP2, "op3_suffix_dedup": OP3, "op6_mixing": OP6, "op7_exact_top_k": OP7}
