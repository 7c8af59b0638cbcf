"""DuckDB SQL for the queries over whole chains, written independently of their plans."""

from __future__ import annotations

from fslink.plans.oracle import BAND, LABELLED, LONG, NEAR, PAIRS, TFIDF_GRAMS, C, _scored
from fslink.plans.views import ALPHA_SAME, CASES_SQL

# Orders as a feed of native cells, and as what they mean.
FEED = f"""
fl AS (SELECT l_orderkey, string_agg(f, '|' ORDER BY f) AS flags FROM (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem) GROUP BY 1),
f0 AS (SELECT o_orderkey AS k, o_orderpriority AS head, o_orderstatus AS st, c_mktsegment AS seg, flags, o_orderdate + to_hours(o_orderkey % 24) AS a, o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_orderkey % 20) AS b, o_orderkey % 9 = 0 AS dayonly
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN fl ON l_orderkey = o_orderkey),
f1 AS (SELECT *, CASE head WHEN '1-URGENT' THEN 'HOME' WHEN '2-HIGH' THEN 'SHOP' WHEN '3-MEDIUM' THEN 'CAR' END AS crime_type, date_trunc('minute', b + to_hours(24)) AS registered,
  date_trunc(CASE WHEN dayonly THEN 'day' ELSE 'minute' END, a) AS beg, date_trunc(CASE WHEN dayonly THEN 'day' ELSE 'minute' END, b) AS fin FROM f0),
f2 AS (SELECT *, substr(sha1('X' || k || year(registered)), 1, 16) AS case_id, CASE WHEN crime_type = 'CAR' THEN 'vehicle' ELSE 'house' END AS family, hour(beg + (fin - beg) / 2) AS h,
  CASE WHEN dayonly THEN '__MISSING__' WHEN epoch(fin) - epoch(beg) > 43200 THEN '__UNKNOWABLE__' END AS band_status, k % 7 = 0 AS no_group, k % 10 = 0 OR flags IS NULL AS no_tools FROM f1 WHERE crime_type IS NOT NULL),
n AS (SELECT case_id, 'X' AS state_code, 'D' || (k % 5) AS district, crime_type, family, beg, fin, registered, CASE WHEN band_status IS NULL THEN {BAND} END AS time_band, band_status AS time_band__status,
  CASE WHEN NOT no_group THEN CASE st WHEN 'O' THEN '1' WHEN 'F' THEN '2-3' WHEN 'P' THEN '4+' END END AS group_, CASE WHEN no_group THEN '__MISSING__' END AS group__status,
  CASE WHEN NOT no_tools THEN array_to_string(list_filter([CASE WHEN contains(flags, 'A') THEN 'crowbar' END, CASE WHEN contains(flags, 'R') THEN 'cutter' END], lambda x: x IS NOT NULL), ';') END AS tools, CASE WHEN no_tools THEN '__MISSING__' END AS tools__status,
  CASE WHEN family = 'house' THEN CASE seg WHEN 'MACHINERY' THEN 'roof' WHEN 'BUILDING' THEN 'wall' WHEN 'AUTOMOBILE' THEN 'gate' WHEN 'FURNITURE' THEN 'window' WHEN 'HOUSEHOLD' THEN 'lock' END END AS door, CASE WHEN family = 'house' AND seg IS NULL THEN '__MISSING__' END AS door__status, k FROM f2)
"""


def _provenance(source: str = "source") -> str:
    """The fields with where their values come from; the window's band is always the source's."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{f}' ELSE '{f}={'source' if f == 'time_band' else source}' END" for f, c in (("time_band", "time_band"), ("group", "group_"), ("tools", "tools"), ("target", "target"), ("door", "door"))) + ")"


FREE = f"""SELECT case_id, state_code, CAST(NULL AS VARCHAR) AS district, crime_type, family, '2021-03-04 22:30' AS occurred_from, '2021-03-05 00:30' AS occurred_to, '2021-03-06 08:00' AS registered_at, time_band, group_ AS "group", tools, target, door,
  CAST(NULL AS VARCHAR) AS time_band__status, CASE WHEN group_ IS NULL THEN '__MISSING__' END AS group__status, CASE WHEN tools IS NULL THEN '__MISSING__' END AS tools__status, CASE WHEN target IS NULL THEN '__MISSING__' END AS target__status, CASE WHEN family = 'house' THEN '__MISSING__' END AS door__status, {_provenance('llm_extracted')} AS provenance, true AS needs_enrichment
FROM (SELECT substr(sha1('Z' || doc_id || '2021'), 1, 16) AS case_id, 'Z' AS state_code, CASE lang WHEN 'en' THEN 'HOME' WHEN 'de' THEN 'SHOP' ELSE 'CAR' END AS crime_type, CASE lang WHEN 'fr' THEN 'vehicle' ELSE 'house' END AS family, 'night' AS time_band, CASE WHEN contains(t, ' on ') THEN '1' WHEN contains(t, 'the') THEN '2-3' WHEN contains(t, 'der') THEN '4+' END AS group_,
  CASE WHEN contains(t, 'with') AND contains(t, 'from') THEN 'crowbar;cutter' WHEN contains(t, 'with') THEN 'crowbar' WHEN contains(t, 'from') THEN 'cutter' WHEN contains(t, 'is') THEN '' END AS tools, CASE WHEN contains(t, 'for') THEN 'shop' END AS target, CAST(NULL AS VARCHAR) AS door
  FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents) WHERE lang IN ('en', 'de', 'fr'))"""

# The alpha of pairs of two classes, from the entities' own repeats across classes.
ALPHA = f"""xp AS (SELECT a.status AS s1, b.status AS s2, a.segment AS g1, b.segment AS g2, a.quarter AS q1, b.quarter AS q2 FROM cases a JOIN cases b ON a.entity = b.entity AND a.id < b.id AND a.cls <> b.cls),
xr AS (SELECT count(*) FILTER (WHERE a = b) / count(*) AS rate FROM (SELECT s1 AS a, s2 AS b FROM xp UNION ALL SELECT g1, g2 FROM xp UNION ALL SELECT q1, q2 FROM xp) WHERE a IS NOT NULL AND b IS NOT NULL),
alpha AS (SELECT rate, CASE WHEN rate > 0.1 THEN (1 - rate) / (rate - 0.1) ELSE {ALPHA_SAME} END AS al FROM xr)"""
CROSS = "(SELECT al FROM alpha)"
RANK = """,
links AS (SELECT n.case_id, n.partner_id, n.retrieval_rank, t.pair_class, round(t.prior_bits, 6) AS prior_bits, round(t.total_bits, 6) AS total_bits, row_number() OVER (PARTITION BY n.case_id ORDER BY round(t.total_bits, 6) DESC, n.retrieval_rank, n.partner_id) AS rank
  FROM near n JOIN totals t ON t.id_a = n.case_id AND t.id_b = n.partner_id),
labels AS (SELECT id_a, id_b, string_agg(CASE WHEN value_a = value_b THEN field || '=' || value_a ELSE field || ' disagrees' END, '; ' ORDER BY place) AS driven FROM (SELECT *, row_number() OVER (PARTITION BY id_a, id_b ORDER BY abs(round(bits, 6)) DESC, field) AS place FROM con) WHERE place <= 3 GROUP BY 1, 2),
driven AS (SELECT l.*, coalesce(b.driven, '') AS driven_by FROM links l LEFT JOIN labels b ON b.id_a = l.case_id AND b.id_b = l.partner_id)"""
DIRECTED = "pairs AS (SELECT n.case_id AS id_a, n.partner_id AS id_b FROM near n JOIN cases a ON a.id = n.case_id JOIN cases b ON b.id = n.partner_id)"
RANKED = _scored(f"{ALPHA}, {NEAR}, {DIRECTED}", CROSS) + RANK

# Cases with a text: all documents are some order's.
TEXTED = "WITH " + CASES_SQL.replace("cases AS (", "every_case AS (", 1) + ", cases AS (SELECT * FROM every_case WHERE id IN (SELECT doc_id FROM documents)), docs AS (SELECT * FROM documents WHERE doc_id IN (SELECT id FROM cases))"
PLAIN = TFIDF_GRAMS.replace("FROM documents", "FROM docs").replace("(1 + ln(tf)) * idf", "tf * idf").replace("> 0.9 THEN", "> 1.0 THEN")
BY_TEXT = f"""{PLAIN}, v AS (SELECT doc_id, list(coalesce(weight, 0.0) ORDER BY b.bucket) AS v FROM (SELECT doc_id FROM docs) CROSS JOIN (SELECT unnest(range(512)) AS bucket) b LEFT JOIN tfidf USING (doc_id, bucket) GROUP BY doc_id),
sims AS (SELECT a.doc_id AS case_id, b.doc_id AS partner_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS sim FROM v a JOIN v b ON a.doc_id <> b.doc_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC, partner_id) AS retrieval_rank FROM sims) WHERE retrieval_rank <= 50)"""
BATCH = _scored(f"{ALPHA}, {BY_TEXT}, {DIRECTED}", CROSS, f"{TEXTED}, {LONG}") + RANK
EXAMPLES = """pick AS (SELECT 'strongest' AS example, case_id, partner_id, 1 AS o FROM (SELECT * FROM links ORDER BY total_bits DESC, case_id, partner_id LIMIT 1)
  UNION ALL SELECT 'weakest', case_id, partner_id, 2 FROM (SELECT * FROM links ORDER BY total_bits, case_id, partner_id LIMIT 1)
  UNION ALL SELECT 'same_type', case_id, partner_id, 3 FROM (SELECT * FROM links WHERE pair_class = 'same_type' ORDER BY case_id, rank LIMIT 1)
  UNION ALL SELECT 'cross_type', case_id, partner_id, 4 FROM (SELECT * FROM links WHERE pair_class = 'cross_type' ORDER BY case_id, rank LIMIT 1))"""

EXAMPLE = """(VALUES (1, 'entry point', 'roof', 0.06, true), (2, 'entry method', 'lock_broken', 0.45, true), (3, 'premise', 'independent_house', 0.42, true), (4, 'occupancy', '–', 0.58, false), (5, 'time band', 'night', 0.52, true), (6, 'search pattern', 'selective', 0.28, true),
  (7, 'counter forensic', 'cctv_disabled', 0.03, true), (8, 'group size est', '2-3', 0.48, true), (9, 'tools: cutter', 'True', 0.16, true), (10, 'property taken: gold', 'True', 0.61, true), (11, 'property taken: cash', 'True', 0.54, true)) v(place, field, value, u, agree)"""
FEATURES = ", ".join(f"coalesce(sum(bits) FILTER (WHERE split_part(field, ':', 1) = '{f}'), 0) AS {f}" for f in ("status", "segment", "quarter", "flags", "region", "season"))
SPLIT = "CAST(('0x' || substr(md5('7:' || entity), 1, 8)) AS BIGINT) / 4294967296"



def _uniform(slot: str, key: str = "id") -> str:
    return f"CAST('0x' || substr(md5('7:{slot}:' || {key}), 1, 8) AS BIGINT) / 4294967296"


ORACLES: dict[str, str] = {
    "csv_feeds": "SELECT o_orderpriority AS HEAD, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS blank FROM orders GROUP BY 1",
    "normalise_feed": f"""WITH {FEED}, p AS (SELECT *, CAST(NULL AS VARCHAR) AS target FROM n) SELECT case_id, state_code, district, crime_type, family, strftime(beg, '%Y-%m-%d %H:%M') AS occurred_from, strftime(fin, '%Y-%m-%d %H:%M') AS occurred_to, strftime(registered, '%Y-%m-%d %H:%M') AS registered_at, time_band, group_ AS "group", tools, target, door, time_band__status, group__status, tools__status, '__ABSENT__' AS target__status, door__status, {_provenance()} AS provenance, 'Order, ' || k AS narrative_text, false AS needs_enrichment FROM p""",
    "normalise_free_text": FREE,
    "enrich_cases": FREE,
    "hosted_extractor": "SELECT doc_id, CASE WHEN contains(t, 'with') THEN 'crowbar' WHEN contains(t, 'from') OR contains(t, ' on ') THEN NULL ELSE '' END AS tools, CASE WHEN contains(t, 'with') THEN '1' WHEN contains(t, 'from') OR contains(t, ' on ') THEN NULL ELSE '4+' END AS \"group\", CAST(NULL AS VARCHAR) AS door FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "normaliser_gate": f"WITH {FEED}, x AS (SELECT 'group' AS field, group_ AS want, CAST('0x' || substr(case_id, 1, 4) AS BIGINT) % 10 <> 0 AS ok FROM n UNION ALL SELECT 'tools', tools, true FROM n UNION ALL SELECT 'door', door, true FROM n) SELECT 'X' AS state_code, field, count(*) AS n, round(avg(CAST(ok AS DOUBLE)), 6) AS agreed, avg(CAST(ok AS DOUBLE)) >= 0.95 AS passed FROM x WHERE want IS NOT NULL GROUP BY field",
    "serving_projection": f"""WITH {FEED} SELECT case_id, strftime(beg, '%Y-%m-%dT%H:%M:%S') AS occurred_from, strftime(registered, '%Y-%m-%dT%H:%M:%S') AS registered_at, coalesce(group_, group__status) AS "group", coalesce(time_band, time_band__status) AS time_band, '__ABSENT__' AS target, coalesce(door, door__status) AS door FROM n""",
    "worked_example": f"WITH w AS (SELECT place, field, value, CAST(u AS DOUBLE) AS u, ({ALPHA_SAME} * u + 1) / ({ALPHA_SAME} + 1) AS m, agree FROM {EXAMPLE}), b AS (SELECT place, field, value, u, m, CASE WHEN agree THEN log2(m / u) ELSE log2((1 - m) / (1 - u)) END AS bits FROM w), a AS (SELECT * FROM b UNION ALL SELECT 12, 'TOTAL', '–', NULL, NULL, sum(bits) FROM b) SELECT CAST(place AS BIGINT) AS place, field, value, u, round(m, 6) AS m, round(bits, 6) AS bits, CASE WHEN bits > 0 THEN '+' WHEN bits < 0 THEN '−' ELSE '' END || printf('%.2f bits', abs(bits)) AS shown FROM a",
    "alpha_selection": f"{C}, {ALPHA} SELECT round(rate, 6) AS rate, CAST({ALPHA_SAME} AS DOUBLE) AS alpha_same, round(al, 6) AS alpha_cross FROM alpha",
    "link_batch": f"{BATCH} SELECT case_id, partner_id, rank, total_bits, prior_bits, pair_class, driven_by FROM driven",
    "candidate_scores": f"{_scored(f'{ALPHA}, {NEAR}, pairs AS (SELECT DISTINCT least(case_id, partner_id) AS id_a, greatest(case_id, partner_id) AS id_b FROM near)', CROSS)} SELECT t.id_a, t.id_b, t.pair_class, coalesce(CAST(a.entity = b.entity AS INTEGER), 0) AS label, round(t.total_bits, 6) AS raw FROM totals t JOIN cases a ON a.id = t.id_a JOIN cases b ON b.id = t.id_b",
    "model_scores": f"{_scored(PAIRS)}, w AS (SELECT id_a, id_b, {FEATURES} FROM con GROUP BY 1, 2), s AS (SELECT id_a, id_b, 0.5 * status - 0.25 * segment + quarter + 0.75 * flags + 0.125 * region - 1.5 AS s FROM w) SELECT id_a, id_b, round(s, 6) AS score, round(CASE WHEN s <= -2 THEN 0.0 WHEN s <= -1 THEN (s + 2) * 0.125 WHEN s <= 0 THEN 0.125 + (s + 1) * 0.375 WHEN s <= 1.5 THEN 0.5 + s * 0.25 ELSE 0.875 END, 6) AS calibrated FROM s",
    "split_pairs": f"{C}, k AS (SELECT id, cls, entity FROM cases WHERE {SPLIT} >= 0.55 AND {SPLIT} < 0.70) SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.cls = b.cls THEN 'same_type' ELSE 'cross_type' END AS pair_class FROM k a JOIN k b ON a.entity = b.entity AND a.id < b.id",
    "probed_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings",
    "multi_k_recall": f"WITH {NEAR}, {LABELLED}, q AS (SELECT k, b.pair_class, b.case_id, count(n.case_id) / count(*) AS recall FROM (SELECT unnest([10, 20, 50]) AS k) CROSS JOIN both_ways b LEFT JOIN near n ON n.case_id = b.case_id AND n.partner_id = b.partner_id AND n.retrieval_rank <= k GROUP BY 1, 2, 3) SELECT CAST(k AS BIGINT) AS k, pair_class, count(*) AS queries, round(avg(recall), 6) AS recall FROM q GROUP BY 1, 2",
    "onehot_keys": f"{C}, k AS (SELECT id, list_sort(list_concat(list_filter(['status=' || status, 'segment=' || segment, 'quarter=' || quarter, 'region=' || region, 'season=' || season], lambda x: x IS NOT NULL), coalesce(list_transform(flags, lambda f: 'flags=' || f), []))) AS keys FROM cases) SELECT id, array_to_string(keys, ',') AS keys, round(1 / sqrt(len(keys)), 6) AS weight FROM k",
    "raw_comparison": f"{C}, l AS (SELECT id, unnest(['status', 'segment', 'quarter', 'flags']) AS field, unnest([status, segment, quarter, CASE WHEN len(flags) = 0 THEN 'none' ELSE array_to_string(flags, ', ') END]) AS v FROM cases WHERE id IN (7, 11)) SELECT a.field, a.v AS value_a, b.v AS value_b FROM l a JOIN l b ON a.field = b.field AND a.id = 7 AND b.id = 11 WHERE a.v IS NOT NULL AND b.v IS NOT NULL",
    "link_examples": f"{RANKED}, {EXAMPLES} SELECT example, case_id, partner_id FROM pick",
    "corpus_counts": f"{C}, e AS (SELECT entity, count(*) AS n, count(DISTINCT quarter) AS p FROM cases WHERE entity IS NOT NULL GROUP BY entity) SELECT (SELECT count(*) FROM cases) AS cases, count(*) FILTER (WHERE n >= 2) AS serial_entities, CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS serial_cases, count(*) FILTER (WHERE n >= 2 AND p > 1) AS relocated_entities FROM e",
    "parquet_sink": "SELECT o_orderpriority AS crime_type, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS year_quarter, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2",
    "json_sink": "SELECT c_custkey, c_mktsegment FROM customer",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "key_range": f"{RANKED} SELECT case_id, partner_id, lpad(CAST(greatest(0, least(999999, 999999 - CAST(round_even((total_bits + 100) * 1000, 0) AS INTEGER))) AS VARCHAR), 6, '0') || '#' || partner_id AS sk FROM links WHERE case_id = 7 ORDER BY sk LIMIT 200",
    "scan_projection": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000",
    "upsert_merge": "WITH new AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey - 1 END AS o_orderkey, 'new' AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0) SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new",
    "update_in_place": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "vector_index": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (3, 5, 8)",
    "demo_export": f"{RANKED}, {EXAMPLES}, ids AS (SELECT case_id FROM pick UNION SELECT partner_id FROM links WHERE case_id IN (SELECT case_id FROM pick)) SELECT c.id AS case_id, c.cls, l.links FROM cases c LEFT JOIN (SELECT case_id, count(*) AS links FROM links WHERE case_id IN (SELECT case_id FROM ids) GROUP BY 1) l ON l.case_id = c.id WHERE c.id IN (SELECT case_id FROM ids)",
    "truth_recorded": "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS rec_status FROM orders WHERE o_orderkey % 3 = 0",
    "case_with_truth": "SELECT o_orderkey, o_orderstatus, o_custkey AS entity FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3 AND o_custkey IS NOT NULL",
    "chunk_ids": "SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + 999) // 1000) FROM orders) AS chunk FROM orders",
    "metadata_facts": "WITH r AS (SELECT substr(sha1('X' || o_orderkey || year(o_orderdate)), 1, 16) AS case_id, o_orderstatus AS s, o_orderkey % 997 AS serial, o_orderdate AS reg FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY reg, case_id) - 1 AS place, count(*) OVER (PARTITION BY s) AS total FROM r) SELECT case_id, round(place / total, 6) AS place, round(CAST('0x' || substr(case_id, 1, 8) AS BIGINT) / 4294967296, 9) AS hash, CAST(serial AS DOUBLE) AS serial, round(floor(epoch(reg)) / 86400, 6) AS day FROM p",
    "recording_errors": f"""{C}, r AS (SELECT id, substr(cls, 1, 1) AS p, status, segment, {_uniform('confuse:status')} AS cs, {_uniform('pick:status')} AS ps, {_uniform('drop:status')} AS ds, {_uniform('confuse:segment')} AS cg, {_uniform('drop:segment')} AS dg FROM cases),
m AS (SELECT *, CASE p WHEN '1' THEN 0.2 WHEN '3' THEN 0.5 ELSE 0.0 END AS wrong, CASE p WHEN '1' THEN 0.1 WHEN '2' THEN 0.3 ELSE 0.0 END AS drop_s, CASE p WHEN '1' THEN 0.1 WHEN '2' THEN 0.05 ELSE 0.0 END AS drop_g FROM r)
SELECT id AS case_id, CASE WHEN ds >= drop_s THEN CASE WHEN cs >= wrong THEN status WHEN status IN ('F', 'P') THEN 'O' WHEN status = 'O' AND ps < 0.5 THEN 'F' WHEN status = 'O' THEN 'P' ELSE status END END AS rec_status,
  CASE WHEN p <> '3' AND dg >= drop_g THEN CASE WHEN cg >= wrong THEN segment WHEN segment = 'BUILDING' THEN 'MACHINERY' WHEN segment = 'MACHINERY' THEN 'BUILDING' ELSE segment END END AS rec_segment FROM m""",
    "cumulative_offsets": "SELECT event_id, user_id, CAST(sum(event_id % 17) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS offset, CAST(sum(event_id % 17) OVER (PARTITION BY user_id) AS BIGINT) AS span FROM events",
    "drawn_values": f"SELECT o_orderkey, round(u, 6) AS u, CASE WHEN u < 0.5 THEN 'night' WHEN u < 0.8 THEN 'day' ELSE 'early' END AS value FROM (SELECT o_orderkey, {_uniform('value', 'o_orderkey')} AS u FROM orders)",
    "applicable_fields": "SELECT cls, CAST(place AS BIGINT) AS place, field FROM (VALUES ('HOME'), ('SHOP'), ('CAR')) c(cls), (VALUES (1, 'time_band'), (2, 'group'), (3, 'tools'), (4, 'target'), (5, 'door')) f(place, field) WHERE cls <> 'CAR' OR field <> 'door'",
    "tilted_chances": "WITH v AS (SELECT * FROM (VALUES ('a', 0.5, 1.0, 0.0, 't', 0.1), ('b', 0.3, 0.0, -1.0, 'u', 0.6), ('c', 0.2, 0.5, 0.5, 'v', 1.0)) v(one, p1, x, y, many, p2), (VALUES (0.0), (0.75)) t(tau)), s AS (SELECT one, many, CAST(p1 AS DOUBLE) AS p1, CAST(p2 AS DOUBLE) AS p2, CAST(tau AS DOUBLE) AS tau, CAST(tau * (x * 0.8 - y * 0.4) AS DOUBLE) AS shift FROM v) SELECT 'one' AS kind, tau, one AS value, round(p1 * exp(shift) / sum(p1 * exp(shift)) OVER (PARTITION BY tau), 9) AS p FROM s UNION ALL SELECT 'many', tau, many, round(CASE WHEN p2 IN (0, 1) THEN p2 ELSE 1 / (1 + exp(-(ln(p2 / (1 - p2)) + shift))) END, 9) FROM s",
    "serve_case": "SELECT o_orderkey AS case_id, o_orderpriority AS crime_type, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS registered_at, CAST(200 AS BIGINT) AS status, CAST(404 AS BIGINT) AS unknown FROM orders WHERE o_orderkey = 7",
    "serve_links": f"{RANKED} SELECT scope, CAST(200 AS BIGINT) AS status, partner_id, rank, total_bits, pair_class, driven_by FROM (SELECT 'same' AS scope, * FROM driven WHERE case_id = 7 AND pair_class = 'same_type' ORDER BY rank LIMIT 5) UNION ALL SELECT 'all', CAST(200 AS BIGINT), partner_id, rank, total_bits, pair_class, driven_by FROM (SELECT * FROM driven WHERE case_id = 7 ORDER BY rank LIMIT 10)",
    "serve_cluster": f"WITH RECURSIVE {NEAR}, ed AS (SELECT case_id AS a, partner_id AS b FROM near WHERE sim >= 0.35), sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(n) AS (SELECT 7 UNION SELECT s.b FROM reach q JOIN sym s ON s.a = q.n) SELECT CAST(min(n) AS BIGINT) AS cluster_id, count(*) AS size, (SELECT count(*) FROM ed WHERE a IN (SELECT n FROM reach)) AS edges FROM reach HAVING count(*) > 1",
    "feedback_post": "SELECT pair_id, judgement, 'me' AS actor_id, '201,201,400,400,400' AS codes FROM (VALUES ('a#b', 'confirmed'), ('b#a', 'rejected')) v(pair_id, judgement)",
    "pii_gate": "SELECT action, CAST(n AS BIGINT) AS n, '403,403,200' AS codes FROM (VALUES ('pii_allow', 1), ('pii_deny', 2)) v(action, n)",
    "role_matrix": "SELECT role, store, reached = 1 AS reached FROM (SELECT r.role, s.store, CASE WHEN list_contains(r.stores, s.store) THEN 1 ELSE 0 END AS reached FROM (VALUES ('ingest', ['raw', 'cases', 'audit']), ('link', ['cases', 'links', 'config', 'audit']), ('api', ['cases', 'links', 'feedback', 'audit']), ('pii', ['pii', 'audit'])) r(role, stores), (VALUES ('audit'), ('cases'), ('config'), ('feedback'), ('links'), ('pii'), ('raw')) s(store))",
}
