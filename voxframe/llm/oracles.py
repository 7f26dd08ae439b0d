"""DuckDB SQL for the queries that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s
), o AS (
  SELECT *, most / w AS r, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), l AS (
  SELECT coalesce(arg_min(level, k) FILTER (WHERE level <= r), 0) AS level FROM o
), t AS (
  SELECT source, source_size, round(least(most, w * l.level), 6) AS target FROM w, l
), x AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line, len(lines) AS n FROM d
), k AS (
  SELECT *, trim(translate(line, '{UP}', '{LOW}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), c AS (
  SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.least AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL = {"op1_source_mix": OP1, "op9_line_dedup": OP9}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '{WORDS}'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL
), i AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM i)
), lens AS (SELECT DISTINCT n FROM g),
o AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), m AS (
  SELECT o.doc_id, o.n, o.s, g.item_id FROM o JOIN g ON o.win = g.win AND o.n = g.n
), h AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL |= {"op5_decontaminate": OP5}

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL |= {"op10_top_k": OP10}

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

ORACLE_SQL |= {"op8_jaccard_join": OP8}

OP3 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, payload, sha1(payload) AS hex FROM p
), b AS (
  SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(hex, CAST(i + 1 AS INTEGER), 1)) - 1) AS x FROM h
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM b
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((x[(5 * i) // 4 + 1] * 16 + coalesce(x[(5 * i) // 4 + 2], 0)) // CAST(2 ^ (3 - (5 * i) % 4) AS BIGINT)) % 32) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

ORACLE_SQL |= {"op3_warc": OP3}

NEAREST = "SELECT x.rid, x.p, arg_min(b.k, {d} * 64 + b.k) AS k, min({d}) AS d FROM x JOIN {book} b ON b.p = x.p GROUP BY x.rid, x.p"
MEANS = """SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN (
    SELECT x.p, a.k, [CAST(floor(sum(x.x[1]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[2]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[3]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[4]) / count(*)) AS BIGINT)] AS e
    FROM x JOIN {a} a ON a.rid = x.rid AND a.p = x.p GROUP BY x.p, a.k) m ON m.p = b.p AND m.k = b.k"""
SQUARE = "(" + " + ".join(f"(x.x[{i}] - b.e[{i}]) * (x.x[{i}] - b.e[{i}])" for i in (1, 2, 3, 4)) + ")"

OP11 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT rid, p, v[4 * p + 1 : 4 * p + 4] AS x FROM v, range(16) r(p)
), b0 AS (SELECT p, rid - 1 AS k, x AS e FROM x WHERE rid <= 64),
a1 AS ({NEAREST.format(book="b0", d=SQUARE)}), b1 AS ({MEANS.format(book="b0", a="a1")}),
a2 AS ({NEAREST.format(book="b1", d=SQUARE)}), b2 AS ({MEANS.format(book="b1", a="a2")}),
a3 AS ({NEAREST.format(book="b2", d=SQUARE)}),
c AS (SELECT rid, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), h
"""

ORACLE_SQL |= {"op11_vector_codes": OP11}

OP12 = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), t AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UP}', '{LOW}') AS w FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || w AS s, w, count(*) AS c FROM r WHERE length(w) >= 7 GROUP BY ALL
), h AS (
  SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, t
), s AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, c FROM h
), n AS (
  SELECT w, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2
), x AS (
  SELECT w, n, i, substr(w, 1, CAST(i AS INTEGER)) || substr(w, CAST(i AS INTEGER) + 2) AS rest FROM (SELECT w, n, unnest(range(length(w))) AS i FROM n)
), p AS (
  SELECT a.w, b.w AS v, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
  UNION SELECT x.w, n.w, n.n FROM x JOIN n ON x.rest = n.w UNION SELECT n.w, x.w, x.n FROM x JOIN n ON x.rest = n.w
), q AS (
  SELECT w, count(*) AS n_near, min({{'m': -m, 'v': v}}) AS top FROM p GROUP BY w
), f AS (
  SELECT n.w, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 10 * n.n THEN top.v END AS form, CASE WHEN -top.m >= 10 * n.n THEN -top.m END AS form_n FROM n LEFT JOIN q USING (w)
), e(w, root) AS (
  SELECT w, w FROM f UNION ALL SELECT e.w, f.form FROM e JOIN f ON f.w = e.root WHERE f.form IS NOT NULL
)
SELECT f.w AS word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (w) WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.w = e.root AND g.form IS NOT NULL)
"""

ORACLE_SQL |= {"op12_spelling_variants": OP12}
