"""SQL forms of the queries of this subpackage that SQL can express, over whole tables.

They are plain quadratic joins: right for checking small tables, no way to run the work.
"""

from __future__ import annotations

_USABLE = """len(embedding) > 0
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
  AND len([x for x in embedding if x <> 0]) > 0"""

# the smallest id that reaches a node passes larger ones only on its way
_CLOSURE = """edge AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS root FROM nodes
  UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id WHERE edge.b > reach.root),
class AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

# the 256 steps of CRC-32, from its rule
_CRC_TABLE = """bit AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""

ORACLES = {
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x
  JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_CLOSURE},
n AS (SELECT a AS id, count(*) AS n_links FROM edge GROUP BY a)
SELECT class.id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, class.id = component_id AS kept
FROM class LEFT JOIN n ON n.id = class.id""",

    "op4_ngram_jaccard": f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
following AS (SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM word
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
shingle AS (SELECT DISTINCT doc_id, concat_ws(' ', w, w2, w3) AS s FROM following WHERE w3 IS NOT NULL OR i = 1),
n AS (SELECT doc_id, count(*) AS n_shingles FROM shingle GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x
  JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 90 * (na.n_shingles + nb.n_shingles - k)),
{_CLOSURE}
SELECT id AS doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id
FROM class LEFT JOIN n ON n.doc_id = id""",

    "op6_warc": """
WITH payload AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digest AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS newest
  FROM payload)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM digest""",

    "op8_nearest_neighbours": f"""
WITH good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)])) AS score FROM good q
  JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",

    "op11_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT id, w, count(*) AS k FROM run GROUP BY id, w),
hashed AS (SELECT w, k, xor(list_reduce([4294967295] || [CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT) FOR j IN range(CAST(len(x) // 2 AS BIGINT))],
  lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295) AS h
  FROM (SELECT *, hex(encode(id || ':' || w)) AS x FROM counted), bit),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM hashed),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS BIGINT)) || chr(1) || substr(word, CAST(i + 1 AS BIGINT)) AS hole,
  substr(word, 1, CAST(i - 1 AS BIGINT)) || substr(word, CAST(i + 1 AS BIGINT)) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT cut.word, vocab.word, vocab.n FROM cut JOIN vocab ON vocab.word = cut.less
  UNION SELECT vocab.word, cut.word, cut.n FROM cut JOIN vocab ON vocab.word = cut.less),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(form := other, n := n), struct_pack(m := -n, o := encode(other))) AS top FROM near GROUP BY word),
formed AS (SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * vocab.n THEN top.form END AS form,
  CASE WHEN top.n >= 5 * vocab.n THEN top.n END AS form_n FROM vocab LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS node, 0 AS steps FROM formed
  UNION ALL SELECT walk.word, formed.form, steps + 1 FROM walk JOIN formed ON formed.word = walk.node WHERE formed.form IS NOT NULL)
SELECT formed.*, last.node AS root FROM formed JOIN (SELECT word, arg_max(node, steps) AS node FROM walk GROUP BY word) last USING (word)""",

    "op12_prefix_trie": f"""
WITH {_CRC_TABLE},
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, xor(list_reduce([4294967295] || [ord(substr(CAST(c AS VARCHAR), CAST(j AS BIGINT), 1)) FOR j IN range(1, length(CAST(c AS VARCHAR)) + 1)],
  lambda s, b: xor(s >> 8, tab[CAST(xor(s & 255, b) + 1 AS BIGINT)])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM own), bit),
part AS (SELECT conv.c, 0 AS side, own.i, said, chars FROM conv JOIN own ON own.c = conv.c - conv.c % 100 AND own.i <= conv.h
  UNION ALL SELECT conv.c, 1, own.i, said, chars FROM conv JOIN own ON own.c = conv.c AND own.i > conv.h),
turn AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, i) AS d, sha256(said) AS s, chars FROM part),
path AS (SELECT c, d, sha256(string_agg(s, ',') OVER (PARTITION BY c ORDER BY d)) AS p, chars FROM turn
  UNION ALL SELECT c, 0, '', 0 FROM conv),
step AS (SELECT *, lag(p) OVER w AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM path WINDOW w AS (PARTITION BY c ORDER BY d)),
node AS (SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM step GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
under AS (SELECT above.d, above.p, sum(CASE WHEN low.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((low.n_convs - 1) * low.chars) AS saved_tokens
  FROM whole low JOIN step above ON above.c = low.conv_id AND above.d <= low.d GROUP BY above.d, above.p)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM whole f JOIN under ON under.d = f.d AND under.p = f.p LEFT JOIN whole u ON u.d = f.d - 1 AND u.p = f.up""",

    "op13_suffix_dedup": """
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, octet_length(b) AS n, b, unnest(range(1, octet_length(b) - 398)) AS i FROM doc WHERE octet_length(b) >= 400),
win AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS h FROM starts),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM win SEMI JOIN again USING (h)),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY r, k),
gap AS (SELECT r, a, z, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS past FROM span),
kept AS (SELECT gap.r, sum(z - a) AS n_removed, count(*) AS n_spans,
  string_agg(hex(array_slice(b, past, a - 1)), '' ORDER BY a) AS front, max(z) AS tail FROM gap JOIN doc USING (r) GROUP BY gap.r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN front IS NULL THEN b ELSE unhex(front || hex(array_slice(b, tail, octet_length(b)))) END) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)""",
}
