"""The same queries in DuckDB's SQL, written independently of the DataFrame plans."""

from __future__ import annotations

from fslink.plans.views import ALPHA_CROSS, ALPHA_SAME, CASES_SQL

C = f"WITH {CASES_SQL}"
M = f"(({ALPHA_SAME} * u + 1) / ({ALPHA_SAME} + 1))"

# Recorded cells, long: one row per recorded value; tags unnest.
LONG = """
cat AS (SELECT id, cls, family, entity, 'core' AS section, 'status' AS field, status AS value FROM cases WHERE status IS NOT NULL
  UNION ALL SELECT id, cls, family, entity, 'core', 'segment', segment FROM cases WHERE segment IS NOT NULL
  UNION ALL SELECT id, cls, family, entity, 'core', 'quarter', quarter FROM cases WHERE quarter IS NOT NULL
  UNION ALL SELECT id, cls, family, entity, 'ext', 'region', region FROM cases WHERE region IS NOT NULL
  UNION ALL SELECT id, cls, family, entity, 'ext', 'season', season FROM cases WHERE season IS NOT NULL),
tag AS (SELECT id, cls, family, unnest(flags) AS value FROM cases WHERE flags IS NOT NULL),
pools AS (
  SELECT 'same_type' AS pool, cls AS key, field, 'categorical' AS kind, value, count(*) AS n FROM cat WHERE section = 'core' GROUP BY cls, field, value
  UNION ALL SELECT 'cross_type', '', field, 'categorical', value, count(*) FROM cat WHERE section = 'core' GROUP BY field, value
  UNION ALL SELECT 'same_family', family, field, 'categorical', value, count(*) FROM cat WHERE section = 'ext' GROUP BY family, field, value
  UNION ALL SELECT 'same_type', cls, 'flags', 'tags', value, count(*) FROM tag GROUP BY cls, value
  UNION ALL SELECT 'cross_type', '', 'flags', 'tags', value, count(*) FROM tag GROUP BY value),
denominators AS (
  SELECT 'same_type' AS pool, cls AS key, 'flags' AS field, count(*) AS total FROM cases WHERE flags IS NOT NULL GROUP BY cls
  UNION ALL SELECT 'cross_type', '', 'flags', count(*) FROM cases WHERE flags IS NOT NULL
  UNION ALL SELECT pool, key, field, sum(n) FROM pools WHERE kind = 'categorical' GROUP BY pool, key, field),
u AS (SELECT p.pool, p.key, p.field, p.kind, p.value, p.n, CAST(d.total AS BIGINT) AS total, p.n / d.total AS u FROM pools p JOIN denominators d USING (pool, key, field))
"""
U = f"{C}, {LONG}"


def _pool(pool: str, kind: str = "categorical") -> str:
    return f"{U} SELECT key, field, value, n, total, round(u, 6) AS u FROM u WHERE pool = '{pool}' AND kind = '{kind}'"


PRIORS = """
pc AS (SELECT entity, cls, count(*) AS n FROM cases GROUP BY entity, cls),
same AS (SELECT cls, sum(CASE WHEN entity IS NOT NULL THEN n * (n - 1) // 2 ELSE 0 END) AS t, sum(n) AS n FROM pc GROUP BY cls),
ent AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT entity, sum(n) AS n FROM pc WHERE entity IS NOT NULL GROUP BY entity)),
tot AS (SELECT sum(n) AS n, sum(t) AS same, sum(n * (n - 1) // 2) AS within FROM same),
pr AS (SELECT 'same_type' AS pair_class, cls AS key, t AS true_pairs, n * (n - 1) // 2 AS all_pairs FROM same
  UNION ALL SELECT 'cross_type', '', ent.t - tot.same, tot.n * (tot.n - 1) // 2 - tot.within FROM ent, tot
  UNION ALL SELECT 'all', '', ent.t, tot.n * (tot.n - 1) // 2 FROM ent, tot),
priors AS (SELECT pair_class, key, CAST(true_pairs AS BIGINT) AS true_pairs, CAST(all_pairs AS BIGINT) AS all_pairs,
  CASE WHEN true_pairs > 0 AND true_pairs < all_pairs THEN log2(true_pairs / (all_pairs - true_pairs)) END AS prior FROM pr)
"""

PAIRS = "pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM cases a JOIN cases b ON a.entity = b.entity AND a.id < b.id)"


def _scored(pairs: str, cross: str = str(ALPHA_CROSS), u: str = U) -> str:
    """Contributions of pairs (id_a, id_b) in a CTE named pairs."""
    return f"""{u}, {PRIORS}, {pairs},
agg AS (SELECT pool, key, field, sum(u * u) AS uf, sum(u) AS su FROM u GROUP BY pool, key, field),
hyd AS (SELECT p.id_a, p.id_b, a.cls = b.cls AS same, a.family = b.family AS kin, a.cls AS cls, a.family AS family, a.status AS s1, b.status AS s2, a.segment AS g1, b.segment AS g2, a.quarter AS q1, b.quarter AS q2, a.region AS r1, b.region AS r2, a.season AS n1, b.season AS n2, a.flags AS f1, b.flags AS f2
  FROM pairs p JOIN cases a ON p.id_a = a.id JOIN cases b ON p.id_b = b.id),
ev AS (SELECT id_a, id_b, same, 'core' AS section, cls, family, 'status' AS field, s1 AS va, s2 AS vb FROM hyd WHERE s1 IS NOT NULL AND s2 IS NOT NULL
  UNION ALL SELECT id_a, id_b, same, 'core', cls, family, 'segment', g1, g2 FROM hyd WHERE g1 IS NOT NULL AND g2 IS NOT NULL
  UNION ALL SELECT id_a, id_b, same, 'core', cls, family, 'quarter', q1, q2 FROM hyd WHERE q1 IS NOT NULL AND q2 IS NOT NULL
  UNION ALL SELECT id_a, id_b, same, 'ext', cls, family, 'region', r1, r2 FROM hyd WHERE kin AND r1 IS NOT NULL AND r2 IS NOT NULL
  UNION ALL SELECT id_a, id_b, same, 'ext', cls, family, 'season', n1, n2 FROM hyd WHERE kin AND n1 IS NOT NULL AND n2 IS NOT NULL),
evp AS (SELECT *, CASE WHEN section = 'ext' THEN 'same_family' WHEN same THEN 'same_type' ELSE 'cross_type' END AS pool, CASE WHEN section = 'ext' THEN family WHEN same THEN cls ELSE '' END AS key, CASE WHEN same THEN {ALPHA_SAME} ELSE {cross} END AS al FROM ev),
catc AS (SELECT e.id_a, e.id_b, e.same, e.cls, e.field, e.va AS value_a, e.vb AS value_b,
  CASE WHEN e.va = e.vb THEN CASE WHEN u.u > 0 THEN log2((e.al * u.u + 1) / (e.al + 1) / u.u) END
       WHEN g.uf > 0 AND g.uf < 1 AND (e.al * g.uf + g.su) / (e.al + 1) < 1 THEN log2((1 - (e.al * g.uf + g.su) / (e.al + 1)) / (1 - g.uf)) END AS bits
  FROM evp e LEFT JOIN u ON u.pool = e.pool AND u.key = e.key AND u.field = e.field AND u.value = e.va LEFT JOIN agg g ON g.pool = e.pool AND g.key = e.key AND g.field = e.field),
tags AS (SELECT id_a, id_b, same, cls, unnest(list_distinct(list_concat(f1, f2))) AS tag, f1, f2, CASE WHEN same THEN {ALPHA_SAME} ELSE {cross} END AS al FROM hyd WHERE f1 IS NOT NULL AND f2 IS NOT NULL),
tagc AS (SELECT t.id_a, t.id_b, t.same, t.cls, 'flags:' || t.tag AS field, CASE WHEN list_contains(f1, tag) THEN 'True' ELSE 'False' END AS value_a, CASE WHEN list_contains(f2, tag) THEN 'True' ELSE 'False' END AS value_b,
  CASE WHEN list_contains(f1, tag) AND list_contains(f2, tag) THEN log2((al * u.u + 1) / (al + 1) / u.u) WHEN u.u < 1 THEN log2((1 - (al * u.u + 1) / (al + 1)) / (1 - u.u)) END AS bits
  FROM tags t LEFT JOIN u ON u.pool = CASE WHEN t.same THEN 'same_type' ELSE 'cross_type' END AND u.key = CASE WHEN t.same THEN t.cls ELSE '' END AND u.field = 'flags' AND u.value = t.tag),
con AS (SELECT * FROM catc WHERE bits IS NOT NULL UNION ALL SELECT * FROM tagc WHERE bits IS NOT NULL),
totals AS (SELECT p.id_a, p.id_b, CASE WHEN h.same THEN 'same_type' ELSE 'cross_type' END AS pair_class, r.prior AS prior_bits, coalesce(r.prior, 0) + coalesce(s.ev, 0) AS total_bits
  FROM pairs p JOIN hyd h USING (id_a, id_b) LEFT JOIN (SELECT id_a, id_b, sum(bits) AS ev FROM con GROUP BY id_a, id_b) s USING (id_a, id_b)
  LEFT JOIN priors r ON r.pair_class = CASE WHEN h.same THEN 'same_type' ELSE 'cross_type' END AND r.key = CASE WHEN h.same THEN h.cls ELSE '' END)"""


def _near(k: int = 50) -> str:
    return f"""e AS (SELECT vec_id, embedding, label FROM embeddings),
sims AS (SELECT a.vec_id AS case_id, b.vec_id AS partner_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) + 0.0 AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, partner_id) AS retrieval_rank FROM sims) WHERE retrieval_rank <= {k})"""


NEAR = _near()
LINKS = _scored(f"{NEAR}, pairs AS (SELECT n.case_id AS id_a, n.partner_id AS id_b FROM near n JOIN cases a ON a.id = n.case_id JOIN cases b ON b.id = n.partner_id)") + """,
links AS (SELECT n.case_id, n.partner_id, n.retrieval_rank, t.pair_class, t.prior_bits, round(t.total_bits, 6) AS total_bits, row_number() OVER (PARTITION BY n.case_id ORDER BY round(t.total_bits, 6) DESC, n.retrieval_rank, n.partner_id) AS rank
  FROM near n JOIN totals t ON t.id_a = n.case_id AND t.id_b = n.partner_id)"""

LABELLED = "v AS (SELECT vec_id, label AS entity, CAST(vec_id % 2 AS VARCHAR) AS cls FROM embeddings), tp AS (SELECT a.entity, a.vec_id AS id_a, b.vec_id AS id_b, CASE WHEN a.cls = b.cls THEN 'same_type' ELSE 'cross_type' END AS pair_class FROM v a JOIN v b ON a.entity = b.entity AND a.vec_id < b.vec_id), both_ways AS (SELECT pair_class, entity, id_a AS case_id, id_b AS partner_id FROM tp UNION ALL SELECT pair_class, entity, id_b, id_a FROM tp)"
CANDIDATES = f"WITH {NEAR}, {LABELLED}, cp AS (SELECT least(case_id, partner_id) AS id_a, greatest(case_id, partner_id) AS id_b, max(sim) AS score FROM near GROUP BY 1, 2), scored AS (SELECT c.id_a, c.id_b, CASE WHEN a.cls = b.cls THEN 'same_type' ELSE 'cross_type' END AS pair_class, CAST(a.entity = b.entity AS INTEGER) AS label, c.score FROM cp c JOIN v a ON a.vec_id = c.id_a JOIN v b ON b.vec_id = c.id_b)"

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
COUNTS = f"terms AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2), hashed AS (SELECT term, {FNV} % 512 AS bucket FROM (SELECT DISTINCT term FROM terms)), counts AS (SELECT doc_id, bucket, CAST(sum(n) AS BIGINT) AS tf FROM terms JOIN hashed USING (term) GROUP BY 1, 2), idf AS (SELECT bucket, count(DISTINCT doc_id) AS df, CASE WHEN count(DISTINCT doc_id) / (SELECT count(*) FROM documents) > 0.9 THEN 0.0 ELSE ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1 END AS idf FROM counts GROUP BY bucket)"
TFIDF = f"{COUNTS}, raw AS (SELECT doc_id, bucket, (1 + ln(tf)) * idf AS w FROM counts JOIN idf USING (bucket)), len AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM raw GROUP BY doc_id), tfidf AS (SELECT doc_id, bucket, CASE WHEN length > 0 THEN w / length ELSE 0.0 END AS weight FROM raw JOIN len USING (doc_id))"
# The same over n-grams of one and two words.
GRAMS = f"(SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE [] END)) AS term FROM (SELECT doc_id, {TOKENS} AS w FROM documents))"
TFIDF_GRAMS = TFIDF.replace(f"(SELECT doc_id, unnest({TOKENS}) AS term FROM documents)", GRAMS)
BAND = "CASE WHEN h >= 22 OR h < 4 THEN 'night' WHEN h < 7 THEN 'early_morning' ELSE 'day' END"
EXPECTED = "expected AS (SELECT cls, value, 1 / 3 AS p FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) a(cls), (VALUES ('O'), ('F'), ('P')) b(value)), realised AS (SELECT e.cls, e.value, count(c.id) AS n, count(c.id) / t.total AS observed, e.p AS expected, t.total FROM expected e JOIN (SELECT cls, count(status) AS total FROM cases GROUP BY cls) t USING (cls) LEFT JOIN cases c ON c.cls = e.cls AND c.status = e.value GROUP BY e.cls, e.value, e.p, t.total)"



def _shuffled(group: str) -> str:
    """null_cells (replicate, group, n, t, nx, ny) of base (id, group, x, y), y shuffled by MD5 order."""
    return f"""many AS (SELECT * FROM base, (SELECT unnest(range(1, 51)) AS replicate)),
xs AS (SELECT replicate, {group}, x, row_number() OVER (PARTITION BY replicate, {group} ORDER BY id) AS k FROM many),
ys AS (SELECT replicate, {group}, y, row_number() OVER (PARTITION BY replicate, {group} ORDER BY md5('1:' || replicate || ':' || id), id) AS k FROM many),
mixed AS (SELECT replicate, {group}, x, y, count(*) AS n FROM xs JOIN ys USING (replicate, {group}, k) GROUP BY ALL),
null_cells AS (SELECT *, sum(n) OVER (PARTITION BY replicate, {group}) AS t, sum(n) OVER (PARTITION BY replicate, {group}, x) AS nx, sum(n) OVER (PARTITION BY replicate, {group}, y) AS ny FROM mixed)"""


SUMMED = f"""{C}, long AS (SELECT id, cls || '|' || unnest(['status|segment', 'status|quarter', 'status|region', 'segment|quarter', 'segment|region', 'quarter|region']) AS g, unnest([status, status, status, segment, segment, quarter]) AS x, unnest([segment, quarter, region, quarter, region, region]) AS y FROM cases),
base AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY g) AS rows_ FROM long WHERE x IS NOT NULL AND y IS NOT NULL) WHERE rows_ >= 50),
seen AS (SELECT *, sum(n) OVER (PARTITION BY g) AS t, sum(n) OVER (PARTITION BY g, x) AS nx, sum(n) OVER (PARTITION BY g, y) AS ny FROM (SELECT g, x, y, count(*) AS n FROM base GROUP BY ALL)),
{_shuffled('g')}, sums AS (SELECT replicate, sum(n / t * log2(n * t / (nx * ny))) AS bits FROM null_cells GROUP BY replicate),
o AS (SELECT coalesce(sum(n / t * log2(n * t / (nx * ny))), 0) AS observed FROM seen), z AS (SELECT coalesce(avg(bits), 0) AS null_mean, coalesce(max(bits), 0) AS null_max FROM sums)
SELECT round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_max, 6) AS null_max, round(observed - null_mean, 6) AS excess FROM o, z"""

ORACLES: dict[str, str] = {
    "normalise_labels": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' WHEN 'P' THEN 'partial' END AS status FROM orders",
    "scope_drop": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'medium' END AS crime_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "tag_split": "SELECT l_orderkey, coalesce(string_agg(CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END, ';' ORDER BY l_returnflag), '') AS tags FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY l_orderkey",
    "native_rendering": "SELECT o_orderkey, o_orderstatus AS status_cell, coalesce(f, '') AS flags_cell FROM orders LEFT JOIN (SELECT l_orderkey, coalesce(string_agg(CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'RETURNED' END, ' / ' ORDER BY l_returnflag), 'NONE_OBSERVED') AS f FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey",
    "summed_information": SUMMED,
    "permutation_null": f"{C}, base AS (SELECT id, cls, status AS x, segment AS y FROM cases WHERE status IS NOT NULL AND segment IS NOT NULL), {_shuffled('cls')} SELECT replicate, cls, CAST(max(t) AS BIGINT) AS n, round(sum(n / t * log2(n * t / (nx * ny))), 8) AS mi_bits FROM null_cells GROUP BY replicate, cls",
    "case_id_hash": "SELECT o_orderkey, substr(sha1(o_orderpriority || o_orderkey || year(o_orderdate)), 1, 16) AS case_id FROM orders",
    "time_band": f"SELECT event_id, CASE WHEN w > 43200 THEN '__UNKNOWABLE__' ELSE {BAND} END AS band FROM (SELECT event_id, w, hour(make_timestamp(epoch_us(ts) + w * 500000)) AS h FROM (SELECT event_id, ts, CAST(floor(abs(value) * 900) AS BIGINT) AS w FROM events))",
    "year_quarter": "SELECT o_orderkey, o_orderpriority || '#' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS key FROM orders",
    "phrase_extract": "SELECT doc_id, CASE WHEN contains(t, 'with') AND contains(t, 'from') THEN 'with;from' WHEN contains(t, 'with') THEN 'with' WHEN contains(t, 'from') THEN 'from' WHEN contains(t, 'the') THEN '' END AS tools, CASE WHEN contains(t, ' on ') THEN 'on' WHEN contains(t, 'the') THEN 'the' END AS mode FROM (SELECT doc_id, lower(text) AS t FROM documents)",
    "u_by_class": _pool("same_type"),
    "u_by_family": _pool("same_family"),
    "u_pooled": _pool("cross_type"),
    "u_tags": _pool("same_type", "tags"),
    "u_window": f"{C} SELECT cls, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cls), 6) AS u FROM cases WHERE status IS NOT NULL GROUP BY cls, status",
    "u_grouping_sets": f"{C} SELECT cls, segment AS value, count(*) AS n FROM cases WHERE segment IS NOT NULL GROUP BY GROUPING SETS ((cls, segment), (segment))",
    "field_aggregate": f"{U} SELECT pool, key, field, round(sum(u * u), 6) AS u_field, round(sum(u * {M}), 6) AS m_field FROM u GROUP BY pool, key, field",
    "weights_table": f"{U} SELECT pool, key, field, value, round({M}, 6) AS m, round(log2({M} / u), 6) AS agree_bits, CASE WHEN u < 1 THEN round(log2((1 - {M}) / (1 - u)), 6) END AS disagree_bits FROM u",
    "prior_bits": f"{C}, {PRIORS} SELECT pair_class, key, true_pairs, all_pairs, round(prior, 6) AS prior FROM priors",
    "pair_stats": f"{C}, p AS (SELECT a.cls <> b.cls AS x, a.quarter <> b.quarter AS y FROM cases a JOIN cases b ON a.entity = b.entity AND a.id < b.id), s AS (SELECT count(*) AS t, count(*) FILTER (WHERE x) AS x, count(*) FILTER (WHERE y) AS y FROM p), n AS (SELECT count(*) AS n FROM cases) SELECT t AS true_pairs, x AS cross_class, y AS cross_place, n * (n - 1) // 2 AS all_pairs, round(log2(t / (n * (n - 1) // 2 - t)), 3) AS prior_bits FROM s, n",
    "cross_repeat_rate": f"{C}, p AS (SELECT a.status AS s1, b.status AS s2, a.segment AS g1, b.segment AS g2, a.quarter AS q1, b.quarter AS q2 FROM cases a JOIN cases b ON a.entity = b.entity AND a.id < b.id AND a.cls <> b.cls), x AS (SELECT s1 AS a, s2 AS b FROM p UNION ALL SELECT g1, g2 FROM p UNION ALL SELECT q1, q2 FROM p) SELECT count(*) FILTER (WHERE a = b) AS agreed, count(*) AS compared, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS rate FROM x WHERE a IS NOT NULL AND b IS NOT NULL",
    "true_pairs": f"{C} SELECT a.entity, a.id AS id_a, b.id AS id_b, CASE WHEN a.cls = b.cls THEN 'same_type' ELSE 'cross_type' END AS pair_class FROM cases a JOIN cases b ON a.entity = b.entity AND a.id < b.id",
    "pair_contributions": f"{_scored(PAIRS)} SELECT id_a, id_b, CASE WHEN same THEN 'same_type' ELSE 'cross_type' END AS pair_class, field, value_a, value_b, round(bits, 6) AS bits FROM con",
    "pair_totals": f"{_scored(PAIRS)} SELECT id_a, id_b, pair_class, round(prior_bits, 6) AS prior_bits, round(total_bits, 6) AS total_bits FROM totals",
    "feature_vector": f"{_scored(PAIRS)} SELECT id_a, id_b, {', '.join(f'''round(coalesce(sum(bits) FILTER (WHERE split_part(field, ':', 1) = '{f}'), 0), 6) AS {f}''' for f in ('status', 'segment', 'quarter', 'flags', 'region', 'season'))} FROM con GROUP BY id_a, id_b",
    "driven_by": f"{_scored(PAIRS)} SELECT id_a, id_b, place, CASE WHEN value_a = value_b THEN field || '=' || value_a ELSE field || ' disagrees' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY id_a, id_b ORDER BY abs(round(bits, 6)) DESC, field) AS place FROM con) WHERE place <= 3",
    "waterfall": f"{_scored(PAIRS)}, w AS (SELECT c.id_a, c.id_b, c.field, round(c.bits, 6) AS bits, coalesce(t.prior_bits, 0) AS base FROM con c JOIN totals t USING (id_a, id_b)), s AS (SELECT *, row_number() OVER o AS step, base + sum(bits) OVER (o ROWS UNBOUNDED PRECEDING) AS after FROM w WINDOW o AS (PARTITION BY id_a, id_b ORDER BY abs(bits) DESC, field)) SELECT id_a, id_b, step, field, round(after - bits, 4) AS before, round(after, 4) AS after FROM s",
    "tokens": f"SELECT doc_id, len({TOKENS}) AS n, regexp_extract_all(lower(coalesce(text, '') || ' end'), '[a-z0-9]+')[1] AS first FROM documents",
    "ngrams": f"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), g AS (SELECT doc_id, list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE [] END) AS g FROM t) SELECT doc_id, len(g) AS n, md5(array_to_string(g, ' ')) AS digest FROM g",
    "fnv_buckets": f"SELECT term, {FNV} AS hash, {FNV} % 512 AS bucket FROM (SELECT DISTINCT unnest({TOKENS}) AS term FROM documents)",
    "idf": f"WITH {COUNTS} SELECT bucket, df, round(idf, 6) AS idf FROM idf",
    "tfidf_weights": f"WITH {TFIDF} SELECT doc_id, bucket, round(weight, 6) AS weight FROM tfidf",
    "idf_ngrams": f"WITH {TFIDF_GRAMS} SELECT bucket, df, round(idf, 6) AS idf FROM idf",
    "tfidf_weights_ngrams": f"WITH {TFIDF_GRAMS} SELECT doc_id, bucket, round(weight, 6) AS weight FROM tfidf",
    "text_topk": f"WITH {TFIDF_GRAMS}, v AS (SELECT doc_id, list(coalesce(weight, 0.0) ORDER BY b.bucket) AS v FROM (SELECT doc_id FROM documents) CROSS JOIN (SELECT unnest(range(512)) AS bucket) b LEFT JOIN tfidf USING (doc_id, bucket) GROUP BY doc_id), sims AS (SELECT a.doc_id AS case_id, b.doc_id AS partner_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS sim FROM v a JOIN v b ON a.doc_id <> b.doc_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, partner_id) AS retrieval_rank FROM sims) WHERE retrieval_rank <= 50",
    "vector_topk": f"WITH {NEAR} SELECT case_id, partner_id, sim, retrieval_rank FROM near",
    "links": f"{LINKS} SELECT case_id, partner_id, rank, total_bits, round(prior_bits, 6) AS prior_bits, pair_class FROM links",
    "links_with_contributions": f"{LINKS} SELECT l.case_id, l.partner_id, coalesce(string_agg(c.field, ',' ORDER BY abs(round(c.bits, 6)) DESC, c.field), '') AS fields FROM links l LEFT JOIN con c ON c.id_a = l.case_id AND c.id_b = l.partner_id GROUP BY l.case_id, l.partner_id",
    "links_scope": f"{LINKS} SELECT case_id, partner_id, rank, total_bits FROM links WHERE case_id = 7 AND pair_class = 'same_type' ORDER BY rank LIMIT 5",
    "bits_sort_key": f"{LINKS} SELECT case_id, partner_id, lpad(CAST(greatest(0, least(999999, 999999 - CAST(round_even((total_bits + 100) * 1000, 0) AS INTEGER))) AS VARCHAR), 6, '0') || '#' || partner_id AS sk FROM links",
    "clusters": f"WITH RECURSIVE {NEAR}, ed AS (SELECT case_id AS a, partner_id AS b, sim FROM near WHERE sim >= 0.35), sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(n, r) AS (SELECT a, a FROM sym UNION SELECT s.b, q.r FROM reach q JOIN sym s ON s.a = q.n WHERE q.r < s.b OR true), root AS (SELECT n, min(r) AS r FROM reach GROUP BY n) SELECT m.r AS cluster_id, m.members, m.size, w.edges, round(w.mean_bits, 9) AS mean_bits FROM (SELECT r, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS members, count(*) AS size FROM root GROUP BY r) m JOIN (SELECT r, count(*) AS edges, avg(sim) AS mean_bits FROM ed JOIN root ON root.n = least(ed.a, ed.b) GROUP BY r) w USING (r)",
    "ego_cluster": f"{LINKS}, m AS (SELECT 7 AS member UNION SELECT partner_id FROM links WHERE case_id = 7 AND total_bits - coalesce(prior_bits, 0) >= 0.0), j AS (SELECT m.member, c.quarter AS place FROM m JOIN cases c ON c.id = m.member) SELECT CAST(member AS BIGINT) AS member, place, (SELECT count(DISTINCT place) > 1 FROM j) AS relocated FROM j",
    "recall_at_k": f"WITH {NEAR}, {LABELLED}, q AS (SELECT b.pair_class, b.case_id, count(n.case_id) / count(*) AS recall FROM both_ways b LEFT JOIN near n USING (case_id, partner_id) GROUP BY 1, 2) SELECT pair_class, count(*) AS queries, round(avg(recall), 6) AS recall FROM q GROUP BY pair_class",
    "entity_recall": f"WITH {NEAR}, {LABELLED}, q AS (SELECT b.entity, count(n.case_id) / count(*) AS recall FROM both_ways b LEFT JOIN near n USING (case_id, partner_id) GROUP BY 1) SELECT count(*) AS entities, round(avg(recall), 6) AS recall FROM q",
    "precision_at_k": f"{CANDIDATES}, ends AS (SELECT pair_class, id_a AS case_id, id_b AS partner_id, label, score FROM scored UNION ALL SELECT pair_class, id_b, id_a, label, score FROM scored), t AS (SELECT *, max(label) OVER (PARTITION BY pair_class, case_id) AS hit, row_number() OVER (PARTITION BY pair_class, case_id ORDER BY score DESC, partner_id) AS place FROM ends), p AS (SELECT pair_class, case_id, avg(label) AS p FROM t WHERE hit = 1 AND place <= 10 GROUP BY 1, 2) SELECT pair_class, count(*) AS queries, round(avg(p), 6) AS precision FROM p GROUP BY pair_class",
    "pr_auc": f"{CANDIDATES}, d AS (SELECT pair_class, score, sum(label) AS h, count(*) AS n FROM scored GROUP BY 1, 2), r AS (SELECT pair_class, score, sum(h) OVER o AS tp, sum(n) OVER o AS seen, sum(h) OVER (PARTITION BY pair_class) AS pos, sum(n) OVER (PARTITION BY pair_class) AS pairs FROM d WINDOW o AS (PARTITION BY pair_class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, tp / seen AS pr, tp / pos AS re FROM r), y AS (SELECT pair_class, pos, pairs, (re - coalesce(lag(re) OVER w, 0)) * (pr + coalesce(lag(pr) OVER w, 1)) / 2 AS a FROM x WINDOW w AS (PARTITION BY pair_class ORDER BY score DESC)) SELECT pair_class, CAST(pos AS BIGINT) AS positives, CAST(pairs AS BIGINT) AS pairs, round(sum(a), 9) AS pr_auc FROM y GROUP BY 1, 2, 3",
    "mutual_information": f"{C}, k AS (SELECT cls, status AS x, segment AS y, count(*) AS n FROM cases WHERE status IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT cls, n, sum(n) OVER (PARTITION BY cls) AS t, sum(n) OVER (PARTITION BY cls, x) AS nx, sum(n) OVER (PARTITION BY cls, y) AS ny FROM k) SELECT cls, CAST(max(t) AS BIGINT) AS n, round(sum(n / t * log2(n * t / (nx * ny))), 8) AS mi_bits FROM w WHERE t >= 50 GROUP BY cls",
    "z_scores": f"{C}, {EXPECTED} SELECT cls, value, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(abs(observed - expected) / sqrt(expected * (1 - expected) / total), 4) AS z FROM realised",
    "drift": f"{C}, {EXPECTED} SELECT cls, value, round(observed / expected - 1, 6) AS drift FROM realised ORDER BY abs(round(observed / expected - 1, 6)) DESC, cls, value LIMIT 15",
    "dispersion": f"{C}, s AS (SELECT entity, count(*) AS n FROM cases WHERE entity IS NOT NULL GROUP BY entity HAVING count(*) >= 2), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, count(*) OVER () AS e FROM s) SELECT count(*) AS entities, (SELECT round(var_samp(n - 2) / avg(n - 2), 6) FROM s) AS dispersion_index, round(sum(n * (n - 1) / 2) FILTER (WHERE k <= greatest(e // 10, 1)) / sum(n * (n - 1) / 2), 6) AS top_tenth_share FROM r",
    "recording_rates": f"{C}, r AS (SELECT region AS place, status AS was, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'X' ELSE status END AS said FROM cases) SELECT place, 'said' AS field, count(*) AS n, round(avg(CASE WHEN said IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recorded, round(avg(CASE WHEN said IS NULL THEN NULL WHEN said <> was THEN 1.0 ELSE 0.0 END), 6) AS confused FROM r WHERE was IS NOT NULL GROUP BY place",
    "first_per_entity": f"{C} SELECT entity, cls, id FROM (SELECT *, row_number() OVER (PARTITION BY entity, cls ORDER BY happened, id) AS k FROM cases) WHERE k = 1",
    "dedupe_pairs": f"WITH {NEAR} SELECT least(case_id, partner_id) AS id_a, greatest(case_id, partner_id) AS id_b, min(retrieval_rank) AS retrieval_rank FROM near GROUP BY 1, 2",
    "serial_number": f"{C} SELECT id, status, year(happened) AS year, row_number() OVER (PARTITION BY status, year(happened) ORDER BY happened, id) AS serial FROM cases",
    "feed_position": f"{C} SELECT id, row_number() OVER (PARTITION BY segment ORDER BY happened, id) - 1 AS position, count(*) OVER (PARTITION BY segment) AS total FROM cases",
    "relocated": f"{C}, f AS (SELECT entity, quarter, first(id ORDER BY happened, id) AS id, min(happened) AS happened FROM cases WHERE entity IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY happened, id) AS k FROM f) SELECT entity, max(id) FILTER (WHERE k = 1) AS first_case, max(id) FILTER (WHERE k = 2) AS second_case FROM k GROUP BY entity HAVING max(k) >= 2",
    "entity_split": f"{C} SELECT entity, CASE WHEN p < 0.55 THEN 'train' WHEN p < 0.70 THEN 'calib' ELSE 'test' END AS split FROM (SELECT DISTINCT entity, CAST(('0x' || substr(md5('7:' || entity), 1, 8)) AS BIGINT) / 4294967296 AS p FROM cases WHERE entity IS NOT NULL)",
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45",
    "feedback_latest": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "stream_ingest": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events WHERE value > 0 GROUP BY event_type",
}
