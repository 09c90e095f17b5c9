"""DuckDB SQL that gives the rows of the corpus queries, where SQL can express them."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM k
"""

OP6 = f"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), lengths AS (
    SELECT DISTINCT m FROM windows
), places AS (
    SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS w
    FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, lengths)
), hits AS (
    SELECT doc_id, i, m, item FROM places JOIN windows USING (m, w)
), covered AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY doc_id
), owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

#: Line templates with the lines and templates themselves where the operator has hashes of them.
OP9 = r"""
WITH l0 AS (SELECT doc_id AS id, string_split(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[ \t\r\f\v]+', ' ', 'g'), chr(10)) AS x FROM documents),
l1 AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM l0),
l AS (SELECT id, pos, trim(line) AS own FROM l1 WHERE trim(line) <> ''),
o AS (SELECT own, count(DISTINCT id) AS documents, min(id) AS keeper, CASE WHEN len(string_split(own, ' ')) >= 3 THEN len(string_split(own, ' ')) || ' ' || array_to_string(string_split(own, ' ')[1:4], ' ') END AS leaf FROM l GROUP BY own),
lv AS (SELECT leaf FROM o WHERE leaf IS NOT NULL GROUP BY leaf HAVING sum(documents) >= 8 AND count(*) > 1),
b AS (SELECT own, leaf, documents, string_split(own, ' ')[5:] AS behind FROM o JOIN lv USING (leaf) WHERE len(string_split(own, ' ')) > 4),
t AS (SELECT own, leaf, documents, CAST(ceil(0.6 * len(behind) - 1e-9) AS INTEGER) AS need, unnest(behind) AS token, generate_subscripts(behind, 1) AS place FROM b),
cm AS (SELECT leaf, place, token, sum(documents) AS n FROM t GROUP BY ALL HAVING sum(documents) >= 8),
rk AS (SELECT own, leaf, need, place, token, row_number() OVER (PARTITION BY own ORDER BY n DESC, place, token) AS r, count(*) OVER (PARTITION BY own) AS size FROM t JOIN cm USING (leaf, place, token)),
tp AS (SELECT own, leaf || '|' || string_agg(place || ':' || token, ' ' ORDER BY r) AS template FROM rk WHERE size >= need AND r <= need GROUP BY own, leaf),
gn AS (SELECT template FROM tp JOIN l USING (own) GROUP BY template HAVING count(DISTINCT id) >= 8),
ig AS (SELECT own, template FROM tp JOIN gn USING (template)),
co AS (SELECT own, bool_or(long) AS long, max(template) AS template FROM (SELECT own, leaf IS NOT NULL AS long, NULL AS template FROM o WHERE documents >= 8 UNION ALL SELECT own, TRUE, template FROM ig) GROUP BY own),
mk AS (SELECT l.id, l.own, co.own IS NULL AS rare, coalesce(co.template, l.own) AS what, coalesce(co.long, FALSE) AS long FROM l LEFT JOIN co USING (own)),
cl AS (SELECT id, coalesce(string_agg(what, chr(10) ORDER BY what) FILTER (WHERE rare), chr(1) || string_agg(what, chr(10) ORDER BY what)) AS class FROM mk GROUP BY id),
pr AS (SELECT DISTINCT class, own FROM mk JOIN cl USING (id) WHERE long),
al AS (SELECT own FROM pr GROUP BY own HAVING count(*) >= 8),
rt AS (SELECT template FROM pr JOIN ig USING (own) GROUP BY template HAVING count(DISTINCT class) >= 8),
mb AS (SELECT ig.template, ig.own, o.keeper FROM ig JOIN rt USING (template) JOIN o USING (own)),
kp AS (SELECT own, min(keeper) AS keeper FROM (SELECT o.own, o.keeper FROM al JOIN o USING (own) UNION ALL SELECT own, min(keeper) OVER (PARTITION BY template) FROM mb) GROUP BY own),
gone AS (SELECT DISTINCT id, pos FROM l JOIN kp USING (own) WHERE id <> keeper),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
y AS (SELECT x.doc_id, count(CASE WHEN trim(line) <> '' THEN 1 END) AS n_lines, count(g.pos) AS n_dropped, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY x.pos) AS kept FROM x LEFT JOIN gone g ON g.id = x.doc_id AND g.pos = x.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN y USING (doc_id)"""

#: Every 50-byte window by its hexadecimal text, runs of windows that a smaller document has, and what is left between them.
OP10 = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS p, h FROM d WHERE len(h) >= 100),
g AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS k FROM w),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM g) WHERE first < doc_id),
s AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f)),
r AS (SELECT doc_id, island, min(p) AS a, max(p) + 50 AS b FROM s GROUP BY 1, 2),
c AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM r),
k AS (SELECT c.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

#: For tables in which a turn of a conversation has one row: a call then never has to wait, as its dependency's result is
#: the turn before it.
OP4 = """
WITH c AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role <> 'assistant'),
r AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
p AS (SELECT c.conv_id, c.call_id, CASE WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS status, c.turn AS call_turn, r.turn AS result_turn, c.turn AS place, 0 AS depth, c.text IS NULL AS missing, coalesce(c.text = '', FALSE) AS short,
    '{"arguments":{"role":' || to_json(c.role) || CASE WHEN c.text IS NULL THEN '' ELSE ',"text":' || to_json(c.text) END || ',"turn":' || c.turn || '},"call_id":"' || c.call_id || '","content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"group":"' || c.conv_id || '","name":"answer","status":"' || CASE WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END || '"}' AS record
    FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn - 1 = c.turn),
o AS (SELECT r.conv_id, r.call_id, r.turn, '{"call_id":"' || r.call_id || '","content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"group":"' || r.conv_id || '","name":null,"status":"orphan"}' AS record FROM r ANTI JOIN c ON r.conv_id = c.conv_id AND r.turn - 1 = c.turn)
SELECT conv_id, call_id, status, call_turn, result_turn, place AS "at", depth, NOT (missing OR short) AS valid, CAST(missing OR short AS BIGINT) AS n_errors, sha256(record) AS record_sha256 FROM p
UNION ALL SELECT conv_id, call_id, 'orphan', NULL, turn, turn, 1, NULL, 0, sha256(record) FROM o"""

WORDS = "coalesce(regexp_extract_all(" + LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

#: crc32 by its table, which the first two steps make, over the bytes of each distinct word.
OP12 = f"""
WITH RECURSIVE steps AS (
    SELECT b, 0 AS k, b AS v FROM (SELECT unnest(range(256)) AS b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY b) AS tab FROM steps WHERE k = 8
), dw AS (
    SELECT doc_id, unnest({WORDS}) AS w FROM documents
), bw AS (
    SELECT unnest({WORDS}) AS w FROM benchmark
), counted AS (
    SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, count(*) AS s, 0 AS t FROM dw GROUP BY w UNION ALL SELECT w, 0, count(*) FROM bw GROUP BY w) GROUP BY w
), hashed AS (
    SELECT w, s, t, xor(list_reduce(list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i - 1, 2)) AS BIGINT)),
        lambda acc, x: xor(acc >> 8, tab[xor(acc & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM counted, crc
), sums AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket
), totals AS (
    SELECT sum(s) AS ss, sum(t) AS tt FROM sums
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums, totals
), sizes AS (
    SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n, 0) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN sizes USING (doc_id)
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, weight + noise DESC, doc_id) AS r, count(*) FILTER (WHERE n >= 20) OVER () AS many FROM scored
)
SELECT doc_id, n AS n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * many // 100 THEN r END AS rank FROM ranked
"""
