"""Oracle SQL (DuckDB) of the operators that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT win.doc_id, win.i + s.j AS i FROM win JOIN least ON least.g = win.g AND least.d < win.doc_id, (SELECT unnest(range(13)) AS j) s),
one AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS word FROM w),
cut AS (SELECT one.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY one.i) FILTER (gone.i IS NULL) AS kept
 FROM one LEFT JOIN gone ON gone.doc_id = one.doc_id AND gone.i = one.i GROUP BY 1)
SELECT w.doc_id, len(l) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS l FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 2], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, least(len(l), 1) + 1))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, min(root) AS component_id FROM r GROUP BY 1) c ON c.d = w.doc_id
"""

SPELLING = r"""
WITH RECURSIVE bit(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY 1, 2),
hx AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM run),
cr AS (SELECT r, n, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM hx, tab),
word AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(r, CAST(h % len(r) AS INT)) || r[CAST(h % len(r) + 2 AS INT):] ELSE r END AS w FROM cr) WHERE len(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT w, n, i, left(w, CAST(i - 1 AS INT)) || '*' || w[i + 1:] AS star FROM (SELECT w, n, unnest(range(1, len(w) + 1)) AS i FROM word)),
pair AS (SELECT a.w, b.w AS near, b.n AS m FROM cut a JOIN cut b ON a.star = b.star AND a.w <> b.w
 UNION SELECT a.w, b.w, b.n FROM cut a JOIN word b ON replace(a.star, '*', '') = b.w UNION SELECT b.w, a.w, a.n FROM cut a JOIN word b ON replace(a.star, '*', '') = b.w),
best AS (SELECT w, count(*) AS n_near, max(m) AS top, first(near ORDER BY m DESC, encode(near)) AS near FROM pair GROUP BY 1),
f AS (SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM word LEFT JOIN best USING (w)),
up(w, root, next) AS (SELECT w, w, form FROM f UNION ALL SELECT up.w, f.w, f.form FROM up JOIN f ON f.w = up.next)
SELECT f.w AS word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.w = f.w AND up.next IS NULL
"""
