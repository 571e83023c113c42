"""DuckDB SQL for the results that SQL can express on small tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id, coalesce(low.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, k, i FROM dw JOIN bw USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM p WHERE i + 34 <= len(w)),
rep AS (SELECT doc_id, i AS start FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
c AS (SELECT p.doc_id, p.i, p.w[p.i] AS word, coalesce(max(start) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) >= p.i - 34, false) AS gone FROM p LEFT JOIN rep ON rep.doc_id = p.doc_id AND rep.start = p.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST(('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32, 1)), '') AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

# The polynomial of CRC-32, reflected, makes the table of its 256 steps.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"


def _crc32(word: str) -> str:
    byte = f"CAST(('0x' || substr(hex(encode({word})), 2 * i + 1, 2)) AS BIGINT)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen({word})), lambda i: {byte})), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT))"


OP11 = f"""
WITH tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, {_SPACED}) GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
hashed AS (SELECT s, {_crc32("s")} % 16384 AS h FROM (SELECT w AS s FROM word UNION SELECT right(w, 1) FROM word), tab),
cell AS (SELECT r, i, a.h AS uni, b.h AS tail FROM word JOIN hashed a ON a.s = word.w JOIN hashed b ON b.s = right(word.w, 1)),
feature AS (SELECT r, uni AS cell FROM cell UNION ALL SELECT a.r, (a.tail % 128) * 128 + b.tail % 128 FROM cell a JOIN cell b ON b.r = a.r AND b.i = a.i + 1),
good AS (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
total AS (SELECT count(*) AS n_raw, count(*) FILTER (r IN (SELECT r FROM good)) AS n_own FROM feature),
counted AS (SELECT cell, count(*) AS raw, count(*) FILTER (r IN (SELECT r FROM good)) AS own FROM feature GROUP BY cell),
weight AS (SELECT cell, CASE WHEN n_own > 0 THEN CAST(round(1e6 * ln((own + 1.0::DOUBLE) * (n_raw + 16384.0::DOUBLE) / ((raw + 1.0::DOUBLE) * (n_own + 16384.0::DOUBLE)))) AS BIGINT) ELSE 0 END AS v FROM counted, total),
score AS (SELECT r, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM feature JOIN weight USING (cell) GROUP BY r),
base AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
coalesce(n, 0) AS n_features, coalesce(CAST(v AS DOUBLE) / n / 1e6, 0.0) AS score, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(v, 0) >= -500000 * coalesce(n, 0) AS kept
FROM base LEFT JOIN score USING (r)
"""

_BIT = "(1 << (ascii({0}) - 65))"

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT
+ 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS f, {_BIT.format("substr(o, step, 1)")} AS b, CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: {_BIT.format("substr(o, k, 1)")})), 0) AS INT) AS e FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step, f, coalesce(sum(n) FILTER (mask & (b + e) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b <> 0 AND mask & e = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & b <> 0 AND mask & e <> 0), 0) AS redundant,
coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & b <> 0 AND mask & e = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & b <> 0 AND mask & e = 0), 0) AS toxic_lost FROM c, s GROUP BY part, o, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

OP13 = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.label AS la, b.id AS b, b.label AS lb, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON b.id <> a.id WHERE a.id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND s.la <> s.lb AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s QUALIFY rank <= 5
"""
