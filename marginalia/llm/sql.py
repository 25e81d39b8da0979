"""DuckDB SQL for those opN queries that SQL can express."""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another; distances to all entries are compared."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT q.r, q.p, min((d, e)) AS best FROM (SELECT q.r, q.p, c.e, list_sum(list_transform(range(1, len(q.v) + 1), lambda j: (q.v[j] - c.v[j]) * (q.v[j] - c.v[j])))::BIGINT AS d FROM q JOIN c{i} c ON c.p = q.p) q GROUP BY 1, 2)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT q.p, best[2] AS e, unnest(q.v) AS x, generate_subscripts(q.v, 1) AS j FROM q JOIN a{i} a ON a.r = q.r AND a.p = q.p) GROUP BY 1, 2, 3),
m{i} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM q WHERE r <= {entries}),
{", ".join(steps)},
done AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN done USING (r)
"""


ORACLES: dict[str, str] = {
    "op9_url_cascade": r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, pattern, host, path) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fit AS (
  SELECT p.page_id, arg_max(r.pattern, length(r.pattern)) AS rule, arg_max(r.verdict, length(r.pattern)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit USING (page_id)
""",
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1) k USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""",
    "op3_suffix_dedup": r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pos AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM h)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS f FROM pos) WHERE f < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM r),
t AS (SELECT q.doc_id, string_agg(substr(x, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM q JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
""",
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT coalesce('#' || doc_id, t)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE f AS (
  SELECT *, row_number() OVER () AS r, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    replace(text, chr(10), '') AS less FROM documents),
crc AS (SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, '') AS s FROM documents),
step(doc_id, s, k, c) AS (
  SELECT doc_id, s, 0, 4294967295::BIGINT FROM crc
  UNION ALL
  SELECT doc_id, s, k + 1, list_reduce(range(8), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, ascii(s[k + 1])::BIGINT)) FROM step WHERE k < length(s)),
odd AS (SELECT doc_id, xor(c, 4294967295) % 2 AS odd FROM step WHERE k = length(s)),
leaf AS (
  SELECT r, f.doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN odd = 0 AND text IS NOT NULL THEN sha256(head || strlen(less) || ':' || less) END AS bad
  FROM f JOIN odd ON f.doc_id IS NOT DISTINCT FROM odd.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaf),
node(lvl, tree, i, n, d) AS (
  SELECT 0, tree, i, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lvl, tree, i // 3, n),
sub AS (SELECT tree, d AS subroot FROM node WHERE n = 1),
top(lvl, i, n, d) AS (
  SELECT 0, tree, count(*) OVER (), subroot FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
whole AS (SELECT lvl, tree, i, n, d FROM node WHERE n > 1 UNION ALL SELECT 1000 + lvl, -1, i, n, d FROM top WHERE n > 1),
way AS (
  SELECT r, l.lvl, p.tree AS tree, p.i // (3 ** l.lvl)::BIGINT AS own FROM placed p JOIN (SELECT DISTINCT lvl, tree FROM whole) l ON l.tree = p.tree
  UNION ALL
  SELECT r, l.lvl, -1, p.tree // (3 ** (l.lvl - 1000))::BIGINT FROM placed p JOIN (SELECT DISTINCT lvl FROM whole WHERE tree = -1) l ON true),
steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM way),
sib AS (
  SELECT r, k, own, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < own), '') AS before, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > own), '') AS after
  FROM steps JOIN whole ON whole.lvl = steps.lvl AND whole.tree = steps.tree AND whole.i // 3 = own // 3 GROUP BY r, k, own),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256, count(*) AS last FROM sib GROUP BY r),
fold(r, k, d) AS (
  SELECT r, 0::BIGINT, coalesce(bad, leaf) FROM placed
  UNION ALL
  SELECT fold.r, sib.k, sha256(before || d || after) FROM fold JOIN sib ON sib.r = fold.r AND sib.k = fold.k + 1),
done AS (SELECT r, arg_max(d, k) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN sub USING (tree) JOIN done USING (r) LEFT JOIN proof USING (r), (SELECT d AS root FROM top WHERE n = 1)
""",
    "op13_ball_tree_codes": _codes_sql(),
}
