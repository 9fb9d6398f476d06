"""DuckDB twins of the operators whose results exact SQL can state."""

WORD = r"[^\x20\x09-\x0D]+"

#: Least node reachable over link(a, b), a < b, for the ids in node(id).
COMPONENTS = """
ends AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT id, id FROM node UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
comp AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 75
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), node AS (SELECT doc_id AS id FROM s), {COMPONENTS}
SELECT doc_id, len(sh)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON doc_id = id
"""

REPEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
v AS (
  SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i
  FROM (SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS hs FROM w WHERE len(ws) >= 50)
), f AS (SELECT h, min(doc_id) AS m FROM v GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM v JOIN f USING (h) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS t, count(gone.j) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
node AS (SELECT vec_id AS id FROM v), {COMPONENTS}, n AS (SELECT x, count(*) AS k FROM ends GROUP BY x)
SELECT vec_id, coalesce(k, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON vec_id = comp.id LEFT JOIN n ON n.x = vec_id
"""
