"""The same results in SQL, for the queries that SQL can express over whole small tables."""

from __future__ import annotations

import string

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str, lower: bool) -> str:
    return f"regexp_extract_all({_LOWER.format(text) if lower else text}, '{pattern}')"


OP3 = f"""WITH dw AS (SELECT doc_id, coalesce({_words("text", _ALNUM, True)}, []) AS w FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_words("text", _ALNUM, True)} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dwin.n, i, item_id FROM dwin JOIN win USING (k)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP6 = f"""WITH RECURSIVE dw AS (SELECT doc_id, coalesce({_words("text", _SPACED, True)}, []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' ' ELSE array_to_string(list_slice(w, i, i + 3), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""

_HOST = r"""regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')"""
OP7 = rf"""WITH cap AS (SELECT page_id, url, {_HOST} AS host, 1704067200 + (page_id % 365) * 86400 + (page_id * 37) % 86400 AS t, count(*) AS n_captures FROM pages GROUP BY ALL),
hosts AS (SELECT DISTINCT {_HOST} AS pattern FROM pages),
listed AS (SELECT pattern, length(pattern) AS n, length(pattern) * 7 % 200 AS d FROM hosts WHERE pattern <> '' AND length(pattern) % 2 = 0),
entries AS (SELECT pattern, 'block' AS action, d FROM listed UNION ALL SELECT pattern, 'lift', d + 60 FROM listed UNION ALL SELECT pattern, CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END, d + 90 FROM listed
  UNION ALL SELECT * FROM (VALUES ('example.net', 'block', 100), ('example.net', 'lift', 130), ('example.org', 'block', 200), ('example.org', 'allow', 260), ('example.com', 'allow', 10)) v(pattern, action, d)),
spans AS (SELECT pattern, action, 1704067200 + d * 86400 AS start, lead(1704067200 + d * 86400) OVER (PARTITION BY pattern ORDER BY d) AS stop FROM entries),
named AS (SELECT page_id, url, t, unnest(list_distinct(list_concat(list_transform(range(1, greatest(2, len(labels))), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')), CASE WHEN folder <> '' THEN [host || folder] ELSE [] END))) AS pattern
  FROM (SELECT *, string_split(host, '.') AS labels, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1) AS folder FROM cap WHERE host <> '')),
best AS (SELECT page_id, url, t, n.pattern, action, start, row_number() OVER (PARTITION BY page_id, url, t ORDER BY length(n.pattern) DESC, n.pattern DESC) AS r
  FROM named n JOIN spans s ON s.pattern = n.pattern AND action <> 'lift' AND start <= t AND (stop IS NULL OR t < stop))
SELECT c.page_id, c.host, c.t AS fetched_s, c.n_captures, b.pattern, b.action, b.start AS listed_s, coalesce(b.action, 'allow') <> 'block' AS kept
FROM cap c LEFT JOIN best b ON b.page_id = c.page_id AND b.url = c.url AND b.t = c.t AND b.r = 1"""

OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN len(q.vec) = 0 OR len(v.vec) = 0 THEN 0 ELSE CAST(list_inner_product(q.vec, v.vec) AS BIGINT) END AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10"""

OP10 = f"""WITH dw AS (SELECT doc_id, coalesce({_words("text", _SPACED, False)}, []) AS w FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS r
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)"""

OP11 = """WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CASE WHEN len(a.vec) = 0 OR len(r.vec) = 0 THEN 0 ELSE CAST(list_inner_product(a.vec, r.vec) AS BIGINT) END AS score FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

# crc32 by the table of its polynomial, byte by byte
_BYTE = "lambda a, z: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END"
_CRC_TABLE = f"crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {_BYTE})) AS t)"


def _crc(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8, given the table t."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)))"


# l are the ends of all groups in order: the largest up to x, the smallest above x, and where a shard ends that is filled from s on
_UP_TO = "coalesce(list_max(list_filter(l, lambda v: v <= {x})), 0)"
_AFTER = "coalesce(list_min(list_filter(l, lambda v: v > {x})), total)"
_FILLED = f"CASE WHEN {{s}} >= total THEN total ELSE greatest({_UP_TO.format(x='{s} + {c}')}, {_AFTER.format(x='{s}')}) END"
OP12 = f"""WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc("coalesce(text, '')")} AS crc, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents, crc),
groups AS (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY key),
ends AS (SELECT key, CAST(sum(size) OVER (ORDER BY size * 16 <= total, key) AS BIGINT) AS e FROM groups, (SELECT sum(size) AS total FROM groups)),
listed AS (SELECT list(e ORDER BY e) AS l, max(e) AS total FROM ends),
search AS (SELECT 0::BIGINT AS low, total AS high FROM listed UNION ALL
  SELECT CASE WHEN ok THEN low ELSE middle END, CASE WHEN ok THEN middle ELSE high END
  FROM (SELECT low, high, middle, list_reduce(list_prepend(0::BIGINT, range(16)), lambda s, i: {_FILLED.format(s="s", c="middle")}) >= total AS ok FROM (SELECT *, (low + high) // 2 AS middle FROM search, listed WHERE high - low > 1))),
capacity AS (SELECT min(high) AS c FROM search),
back AS (SELECT 16 AS k, total AS e FROM listed UNION ALL
  SELECT k - 1, CASE WHEN begin < e OR e = 0 THEN begin ELSE before END
  FROM (SELECT k, e, CASE WHEN e <= c THEN 0 ELSE {_AFTER.format(x="e - c - 1")} END AS begin, {_UP_TO.format(x="e - 1")} AS before FROM back, listed, capacity WHERE k > 1)),
cuts AS (SELECT 0 AS k, 0::BIGINT AS e FROM listed UNION ALL
  SELECT k + 1, greatest(e, least(greatest(CASE WHEN below <= e OR above - even < even - below THEN above ELSE below END, earliest), filled))
  FROM (SELECT *, {_UP_TO.format(x="even")} AS below, CASE WHEN even < total THEN {_AFTER.format(x="even")} ELSE total END AS above
    FROM (SELECT cuts.k, cuts.e, l, total, b.e AS earliest, cuts.e + (total - cuts.e) // (16 - cuts.k) AS even, {_FILLED.format(s="cuts.e", c="c")} AS filled FROM cuts, listed, capacity, back b WHERE cuts.k < 15 AND b.k = cuts.k + 1))),
dealt AS (SELECT d.*, CAST((SELECT count(*) FROM cuts WHERE cuts.k > 0 AND cuts.e < ends.e) AS INTEGER) AS shard FROM docs d JOIN ends USING (key))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || key), 1, 3), doc_id NULLS FIRST, key, size, crc) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

OP13 = rf"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
digested AS (SELECT run, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digested) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
without AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS other FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM without a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM without a JOIN words b ON a.rest = b.word),
near AS (SELECT p.word, p.other, w.n, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS r FROM pairs p JOIN words w ON w.word = p.word JOIN words o ON o.word = p.other),
best AS (SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM near WHERE r = 1),
chain AS (SELECT word, form AS root FROM best WHERE form IS NOT NULL UNION ALL SELECT chain.word, best.form FROM chain JOIN best ON best.word = chain.root WHERE best.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c LEFT JOIN best b ON b.word = c.root WHERE b.form IS NULL)
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN ends USING (word)"""

SQL = {"op3_decontaminate": OP3, "op6_near_dedup": OP6, "op7_url_filter": OP7, "op8_vector_topk": OP8, "op10_substring_dedup": OP10, "op11_hard_negatives": OP11, "op12_sharding": OP12, "op13_spelling": OP13}
