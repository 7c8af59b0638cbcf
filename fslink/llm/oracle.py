"""DuckDB SQL for the corpus operators that SQL can express, written independently of their plans."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# All pairs of texts that share a run of five words; classes by reachability.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS copy_of, count(*) AS copies FROM w WHERE len(w) > 0 GROUP BY 1),
s AS (SELECT DISTINCT copy_of, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t),
n AS (SELECT copy_of, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.copy_of AS a, b.copy_of AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.copy_of < b.copy_of GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.copy_of = a JOIN n y ON y.copy_of = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(n, r) AS (SELECT copy_of, copy_of FROM t UNION SELECT e.b, q.r FROM reach q JOIN e ON e.a = q.n),
r AS (SELECT n, min(r) AS r FROM reach GROUP BY 1),
k AS (SELECT e.a AS n, sum(t.copies) AS links FROM e JOIN t ON t.copy_of = e.b GROUP BY 1)
SELECT w.doc_id, coalesce(r.r, w.doc_id) AS class_id, CAST(coalesce(k.links, 0) + coalesce(t.copies, 1) - 1 AS BIGINT) AS n_links, coalesce(t.copy_of, w.doc_id) AS copy_of
FROM w LEFT JOIN t ON t.t = array_to_string(w.w, ' ') LEFT JOIN r ON r.n = t.copy_of LEFT JOIN k ON k.n = t.copy_of
"""

# Targets by the prefix of sources, least capacity per weight first, that give three times their size.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, sum(size) AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS w, row_number() OVER (ORDER BY 3 * z / (rank % 3 + 1), rank) AS k FROM s),
levels AS (SELECT k, 3 * z / w AS fits, (sum(z) OVER () - coalesce(3 * sum(z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
level AS (SELECT coalesce(min_by(level, k) FILTER (WHERE level <= fits), max(fits)) AS level FROM levels),
f AS (SELECT source, CAST(z AS BIGINT) AS source_size, rank, least((SELECT level FROM level) * w, CAST(3 * z AS DOUBLE)) AS target FROM w),
p AS (SELECT d.*, f.source_size, f.rank, f.target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
x AS (SELECT *, CAST(least(greatest(CAST(round(target) AS BIGINT) - passes * source_size - start, 0), size) AS BIGINT) AS extra, least((start + size / 2) / target, 1.0) AS share FROM p)
SELECT doc_id, source, size, source_size, target, passes * size + extra AS taken,
  CASE WHEN size > 0 AND passes + extra > 0 THEN round(CASE WHEN rank % 2 = 0 THEN sqrt(0.25 + 2 * share) - 0.5 ELSE 1.5 - sqrt(2.25 - 2 * share) END, 9) END AS first_position
FROM x
"""

# Words and one-bit lanes of the paragraphs' digests, summed; lanes s of words 0 and 1, then of 2 and 3.
MULTISET = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT doc_id, next_id, text, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM o),
t AS (SELECT doc_id, 'own' AS kind, text AS t FROM x UNION ALL SELECT doc_id, 'edited', edited FROM x),
u AS (SELECT doc_id, kind, unnest(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS u FROM t),
h AS (SELECT doc_id, kind, list_transform(range(8), lambda k: CAST('0x' || substr(sha256(u), 8 * k + 1, 8) AS BIGINT)) AS w FROM u),
wide AS (SELECT doc_id, kind, count(*) AS n, list_transform([sum(w[1]), sum(w[2]), sum(w[3]), sum(w[4]), sum(w[5]), sum(w[6]), sum(w[7]), sum(w[8])], lambda v: CAST(v % 4294967296 AS BIGINT)) AS v FROM h GROUP BY ALL),
bits AS (SELECT doc_id, kind, s, sum((w[1] >> s) & 1) AS a, sum((w[2] >> s) & 1) AS b, sum((w[3] >> s) & 1) AS c, sum((w[4] >> s) & 1) AS e FROM h, (SELECT unnest(range(32)) AS s) GROUP BY ALL),
lanes AS (SELECT doc_id, kind, list_concat(list(a * 65536 + b ORDER BY s), list(c * 65536 + e ORDER BY s)) AS pairs, list_concat(list_concat(list(a ORDER BY s), list(b ORDER BY s)), list_concat(list(c ORDER BY s), list(e ORDER BY s))) AS l FROM bits GROUP BY ALL),
f AS (SELECT doc_id, kind, upper(printf('%08x', n) || array_to_string(list_transform(list_concat(v, list_transform(pairs, lambda p: CAST(p AS BIGINT))), lambda p: printf('%08x', p)), '')) AS f, list_transform(l, lambda c: CAST(2 * c - n AS BIGINT)) AS s FROM wide JOIN lanes USING (doc_id, kind)),
g AS (SELECT x.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, o.f AS fingerprint, e.f AS edited_fingerprint, o.s AS os, e.s AS es, n.s AS ns FROM x JOIN f o ON o.doc_id = x.doc_id AND o.kind = 'own' JOIN f e ON e.doc_id = x.doc_id AND e.kind = 'edited' JOIN f n ON n.doc_id = x.next_id AND n.kind = 'own'),
dots AS (SELECT *, list_sum(list_transform(os, lambda v: v * v)) AS oo, list_sum(list_transform(es, lambda v: v * v)) AS ee, list_sum(list_transform(ns, lambda v: v * v)) AS nn, list_sum(list_transform(list_zip(os, es), lambda z: z[1] * z[2])) AS oe, list_sum(list_transform(list_zip(os, ns), lambda z: z[1] * z[2])) AS onx FROM g)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN os = es THEN 1.0::DOUBLE WHEN oo + ee = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2 * oe / (oo + ee))) END AS near_edited,
  CASE WHEN os = ns THEN 1.0::DOUBLE WHEN oo + nn = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2 * onx / (oo + nn))) END AS near_next
FROM dots
"""

ORACLES: dict[str, str] = {"op4_jaccard_join": JACCARD, "op7_mixing": MIXING, "op10_multiset_hash": MULTISET}
