"""Queries over whole chains: feeds through the normaliser, the batch linker, stores, the service."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink import linker, serve
from fslink.functions import display as D
from fslink.functions import evidence as E
from fslink.operators import extract, graph, knn, model, studies
from fslink.operators import frequencies as Q
from fslink.operators import normalise as N
from fslink.operators import scoring as S
from fslink.operators import statistics as T
from fslink.operators.embed import OneHot
from fslink.operators.generate import ValueModel, recorded, uniform
from fslink.plans.queries import CLUSTER_SIM, QUERIES, _r, _scored, _vectors, query
from fslink.plans.views import ALPHA_SAME, SPEC, cases, table
from fslink.sources import files, tables
from fslink.sources.shared import settle, shared_path
from fslink.spec import CORE, EXT, FieldSpec, LinkageSpec

__all__ = ["QUERIES"]
REFERENCE = 0.1
CASE, OTHER = 7, 11
# The worked example's fields, values, frequencies, and whether both cases agree.
EXAMPLE = (
    ("entry_point", "roof", 0.06, True), ("entry_method", "lock_broken", 0.45, True), ("premise", "independent_house", 0.42, True), ("occupancy", None, 0.58, False), ("time_band", "night", 0.52, True), ("search_pattern", "selective", 0.28, True),
    ("counter_forensic", "cctv_disabled", 0.03, True), ("group_size_est", "2-3", 0.48, True), ("tools:cutter", "True", 0.16, True), ("property_taken:gold", "True", 0.61, True), ("property_taken:cash", "True", 0.54, True),
)

VOCABULARY = N.Vocabulary(
    classes={"HOME": {"X": "1-URGENT", "Z": "en"}, "SHOP": {"X": "2-HIGH", "Z": "de"}, "CAR": {"X": "3-MEDIUM", "Z": "fr"}},
    fields={
        "group": {"1": {"X": "O", "en": " on "}, "2-3": {"X": "F", "en": "the"}, "4+": {"X": "P", "en": "der"}},
        "tools": {"crowbar": {"X": "A", "en": "with"}, "cutter": {"X": "R", "en": "from"}, N.NONE_OBSERVED: {"X": "N", "en": "is"}},
        "target": {"shop": {"en": "for"}},
        "door": {"roof": {"X": "MACHINERY"}, "wall": {"X": "BUILDING"}, "gate": {"X": "AUTOMOBILE"}, "window": {"X": "FURNITURE"}, "lock": {"X": "HOUSEHOLD"}},
    },
    family_of={"HOME": "house", "SHOP": "house", "CAR": "vehicle"},
    core=("time_band", "group", "tools", "target"),
    ext={"house": ("door",)},
    tags=frozenset({"tools"}),
)
X = N.Feed("X", {"fir_no": "NO", "crime_type": "HEAD", "district": "DIST", "occurred_from": "FROM", "occurred_to": "TO", "registered_at": "REG", "group": "GRP", "tools": "TOOLS", "door": "DOOR", "narrative": "STORY"}, delimiter="|", absent=("target",))
Z = N.Feed("Z", {"fir_no": "no", "crime_type": "head", "occurred_from": "from", "occurred_to": "to", "registered_at": "reg", "mo_description": "mo", "narrative": "story"}, N.FREE_TEXT, "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")


# Feeds and the normaliser


def _native(spark, d) -> DataFrame:
    """Orders as a native feed, one file per status, written as CSV and read again."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("TOOLS"))
    key = F.col("o_orderkey")
    hours = lambda at, n: F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + n * 3600)
    begin = hours(F.col("o_orderdate"), key % 24)
    end = hours(begin, key % 20)
    said = lambda at: F.when(key % 9 == 0, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "dd/MM/yyyy HH:mm"))
    rows = orders.join(customer, "o_custkey", "left").join(flags, "o_orderkey", "left").select(
        key.cast("string").alias("NO"), F.col("o_orderpriority").alias("HEAD"), F.concat(F.lit("D"), (key % 5).cast("string")).alias("DIST"), said(begin).alias("FROM"), said(end).alias("TO"), F.date_format(hours(end, F.lit(24)), "dd/MM/yyyy HH:mm").alias("REG"),
        F.when(key % 7 == 0, "").otherwise(F.col("o_orderstatus")).alias("GRP"), F.when(key % 10 == 0, "").otherwise(F.coalesce("TOOLS", F.lit(""))).alias("TOOLS"), F.coalesce("c_mktsegment", F.lit("")).alias("DOOR"), F.concat(F.lit("Order, "), key.cast("string")).alias("STORY"), "o_orderstatus",
    )
    rows = settle(rows)
    names = list(X.columns.values())
    parts = []
    for status in ("F", "O", "P"):
        path = shared_path(spark, f"feed-{status}")
        files.write_feed(rows.where(F.col("o_orderstatus") == status).select(*names), path)
        parts.append(files.read_feed(spark, path, names))
    return files.union_feeds(parts)


def _normalised(spark, d) -> DataFrame:
    return settle(N.normalise(_native(spark, d), X, VOCABULARY))


def _flat(rows: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    status = [f"{f}__status" for f in ("time_band", "group", "tools", "target", "door")]
    provenance = F.concat_ws(",", *(F.concat_ws("=", F.lit(f), F.try_element_at("field_provenance", F.lit(f))) for f in ("time_band", "group", "tools", "target", "door")))
    return rows.select("case_id", "state_code", "district", "crime_type", "family", iso("occurred_from"), iso("occurred_to"), iso("registered_at"), "time_band", "group", F.array_join("tools", ";").alias("tools"), "target", "door", *status, provenance.alias("provenance"), "narrative_text", "needs_enrichment")


@query
def csv_feeds(spark, d):
    rows = _native(spark, d)
    return rows.groupBy("HEAD").agg(F.count("*").alias("n"), F.count_if(F.col("GRP") == "").alias("blank"))


@query
def normalise_feed(spark, d):
    return _flat(_normalised(spark, d))


def _free(spark, d, extracting):
    docs = table(spark, d, "documents")
    native = docs.select(F.col("doc_id").cast("string").alias("no"), F.col("lang").alias("head"), F.lit("2021-03-04T22:30:00").alias("from"), F.lit("2021-03-05T00:30:00").alias("to"), F.lit("2021-03-06T08:00:00").alias("reg"), F.coalesce("text", F.lit("")).alias("mo"), F.lit("").alias("story"))
    return N.normalise(native, Z, VOCABULARY, extracting)


@query
def normalise_free_text(spark, d):
    return _flat(_free(spark, d, True)).drop("narrative_text")


@query
def enrich_cases(spark, d):
    rows = settle(_free(spark, d, False).withColumn("told", F.lit(None).cast("string")))
    texts = table(spark, d, "documents").select(E.case_id(F.lit("Z"), F.col("doc_id"), F.lit(2021)).alias("case_id"), "text")
    targets = rows.join(tables.enrichment_targets(rows), "case_id", "left_semi").join(texts, "case_id").select("case_id", "crime_type", F.col("text").alias("narrative_text"))
    return _flat(extract.enriched(rows, extract.Clauses()(targets, VOCABULARY), VOCABULARY)).drop("narrative_text")


def _reply(question: str) -> str:
    """A stand-in for a service: good values, values that no vocabulary knows, and no JSON at all."""
    text = question.split("Text:\n", 1)[1].lower()
    if "with" in text:
        return json.dumps({"tools": ["crowbar"], "group": "1", "door": None, "colour": "red"})
    if "from" in text:
        return json.dumps({"tools": ["crowbar", "bogus"], "group": "9"})
    return "no JSON" if " on " in text else json.dumps({"tools": [], "group": "4+"})


@query
def hosted_extractor(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("HOME").alias("crime_type"), F.col("text").alias("narrative_text"))
    found = extract.Hosted(_reply)(rows, VOCABULARY, "doc_id")
    return found.select("doc_id", F.array_join("tools", ";").alias("tools"), "group", "door")


@query
def normaliser_gate(spark, d):
    made = _normalised(spark, d)
    wrong = F.conv(F.substring("case_id", 1, 4), 16, 10).cast("int") % 10 == 0
    truth = made.select("case_id", F.when(wrong & F.col("group").isNotNull(), "other").otherwise(F.col("group")).alias("group"), "tools", "door")
    return N.agreement(made, truth, ["group", "tools", "door"]).select("state_code", "field", "n", _r("agreed"), "passed")


@query
def serving_projection(spark, d):
    shown = serve.case_record(N.nested(_normalised(spark, d), VOCABULARY))
    return shown.select("case_id", "occurred_from", "registered_at", F.col("mo_core.group").alias("group"), F.col("mo_core.time_band").alias("time_band"), F.col("mo_core.target").alias("target"), F.col("mo_ext_house.door").alias("door"))


# Linking


def _texted(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("narrative_text"))
    return cases(spark, d).join(docs, "id")


@query
def worked_example(spark, d):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(EXAMPLE, 1)], "place int, field string, value string, u double, agree boolean")
    m = E.m_of(F.col("u"), ALPHA_SAME)
    scored = rows.select("place", "field", "value", "u", m.alias("m"), F.when(F.col("agree"), E.agreement_bits(m, F.col("u"))).otherwise(E.disagreement_bits(m, F.col("u"))).alias("bits"))
    total = scored.agg(F.lit(len(EXAMPLE) + 1).alias("place"), F.lit("TOTAL").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("m"), F.sum("bits").alias("bits"))
    return scored.union(total).select(F.col("place").cast("long").alias("place"), D.field_text(F.col("field")).alias("field"), D.value_text(F.col("value")).alias("value"), "u", F.round("m", 6).alias("m"), F.round("bits", 6).alias("bits"), D.bits_text(F.col("bits")).alias("shown"))


@query
def alpha_selection(spark, d):
    c = settle(cases(spark, d))
    return Q.cross_repeat_rate(c, SPEC).select(_r("rate"), F.lit(float(ALPHA_SAME)).alias("alpha_same"), F.round(F.lit(linker.cross_alpha(c, SPEC, ALPHA_SAME, REFERENCE)), 6).alias("alpha_cross"))


@query
def link_batch(spark, d):
    links = linker.link_batch(_texted(spark, d), SPEC, ALPHA_SAME, REFERENCE, sink=shared_path(spark, "links"))
    return links.select("case_id", "partner_id", "rank", "total_bits", "prior_bits", "pair_class", F.array_join(S.driven_by_labels(F.col("contributions")), "; ").alias("driven_by"))


def _near_context(spark, d):
    return linker.context(cases(spark, d), SPEC, ALPHA_SAME, REFERENCE, near=settle(_vectors(spark, d)))


@query
def candidate_scores(spark, d):
    return linker.candidates(_near_context(spark, d)).select("id_a", "id_b", "pair_class", "label", _r("raw"))


@query
def lr_weights(spark, d):
    made = linker.train(_near_context(spark, d))
    rows = [(cls, f, w) for cls in linker.CLASSES for f, w in [*zip(made["feature_names"], made[cls]["coef"]), ("bias", made[cls]["bias"])]]
    return spark.createDataFrame(rows, "pair_class string, feature string, weight double")


@query
def isotonic_calibration(spark, d):
    made = linker.train(_near_context(spark, d))
    rows = [(cls, x, y) for cls in linker.CLASSES if made[cls]["calibration"] for x, y in zip(made[cls]["calibration"]["x"], made[cls]["calibration"]["y"])]
    return spark.createDataFrame(rows, "pair_class string, x double, y double")


@query
def evaluation_report(spark, d):
    made = _near_context(spark, d)
    candidates = settle(linker.candidates(made))
    return linker.evaluate(made, linker.train(made, candidates), candidates)


MODEL = {"feature_names": [f.name for f in SPEC.fields], "coef": [0.5, -0.25, 1.0, 0.75, 0.125, 0.0], "bias": -1.5}
STEPS = {"x": [-2.0, -1.0, 0.0, 1.5], "y": [0.0, 0.125, 0.5, 0.875]}


@query
def model_scores(spark, d):
    wide = S.collapsed(_scored(spark, d)[2], SPEC)
    score = model.linear_score(MODEL)
    return wide.select("id_a", "id_b", F.round(score, 6).alias("score"), F.round(model.calibrated(score, STEPS), 6).alias("calibrated"))


@query
def split_pairs(spark, d):
    c = settle(cases(spark, d))
    return model.pairs_within(Q.true_pairs(c, SPEC).select("id_a", "id_b", "pair_class"), model.entity_split(c, "entity"), c.select("id", "entity"), "calib")


def _labelled_context(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), (F.col("vec_id") % 2).cast("string").alias("cls"))
    return linker.context(v, LinkageSpec(id="id", cls="cls", entity="entity"), ALPHA_SAME, REFERENCE, near=settle(_vectors(spark, d)))


@query
def probed_recall(spark, d):
    vectors = table(spark, d, "embeddings")
    near = knn.probed_top_k(vectors, 10, "vec_id", "embedding", list_rows=64)
    hits = near.join(_vectors(spark, d, 10), ["case_id", "partner_id"], "left_semi").count()
    n = vectors.count()
    return spark.createDataFrame([(n, hits >= 0.9 * 10 * n)], "queries long, enough boolean")


@query
def multi_k_recall(spark, d):
    made = _labelled_context(spark, d)
    return linker.recall_at_ks(made, made.near, (10, 20, 50), None).select("k", "pair_class", "queries", _r("recall"))


@query
def onehot_keys(spark, d):
    made = OneHot(SPEC).keys(cases(spark, d))
    return made.select("id", F.array_join("keys", ",").alias("keys"), F.round(1 / F.sqrt(F.size("keys").cast("double")), 6).alias("weight"))


@query
def raw_comparison(spark, d):
    return S.raw_comparison(cases(spark, d), SPEC, CASE, OTHER)


def _ranked(spark, d):
    """Links over ready vectors with their contributions, scored at the fixed alphas."""
    made = linker.link(_near_context(spark, d))
    return settle(made)


@query
def link_examples(spark, d):
    return T.link_examples(_ranked(spark, d))


@query
def corpus_counts(spark, d):
    return T.corpus_counts(cases(spark, d), "entity", "quarter")


# Stores


@query
def parquet_sink(spark, d):
    path = shared_path(spark, "cases")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("crime_type"), F.col("o_orderdate").alias("registered_at"))
    files.write_cases(rows, path)
    found = files.read_table(spark, path, ["o_orderkey", "crime_type", "year_quarter"])
    return found.groupBy("crime_type", "year_quarter").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def json_sink(spark, d):
    path = shared_path(spark, "json")
    files.write_json(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return spark.read.schema("c_custkey long, c_mktsegment string").json(path)


@query
def point_lookup(spark, d):
    return tables.get_item(table(spark, d, "orders"), "o_orderkey", CASE).select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def key_range(spark, d):
    links = S.sort_keys(_ranked(spark, d))
    return tables.query(links, "case_id", CASE, "sk").select("case_id", "partner_id", "sk")


@query
def scan_projection(spark, d):
    return tables.scan(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000))


@query
def upsert_merge(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fresh = rows.where("o_orderkey % 7 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))
    return tables.upsert(rows, fresh, ["o_orderkey"])


@query
def update_in_place(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    change = rows.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "MOVED").alias("c_mktsegment"))
    return tables.update(rows, change, "c_custkey").select("c_custkey", "c_mktsegment")


@query
def vector_index(spark, d):
    path = shared_path(spark, "vectors")
    files.write_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    return files.read_vectors(spark, path, [3, 5, 8, 100000000]).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query
def demo_export(spark, d):
    path = shared_path(spark, "demo")
    links = _ranked(spark, d)
    tables.export_subset(cases(spark, d).withColumnRenamed("id", "case_id"), links, T.link_examples(links), path)
    kept = spark.read.parquet(f"{path}/links").groupBy("case_id").agg(F.count("*").alias("links"))
    return spark.read.parquet(f"{path}/cases").select("case_id", "cls").join(kept, "case_id", "left")


@query
def truth_recorded(spark, d):
    said = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("status"))
    truth = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return tables.truth_with_recorded(truth, said, "o_orderkey")


@query
def case_with_truth(spark, d):
    truth = table(spark, d, "orders").where("o_orderkey % 5 < 4").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("entity"))
    return tables.with_truth(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), truth, "o_orderkey")


@query
def chunk_ids(spark, d):
    return tables.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").withColumn("chunk", F.col("chunk").cast("long"))


@query
def metadata_facts(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select(E.case_id(F.lit("X"), F.col("o_orderkey"), F.year("o_orderdate")).alias("case_id"), F.col("o_orderstatus").alias("state_code"), F.concat_ws("/", F.lit("ST"), F.lpad((F.col("o_orderkey") % 997).cast("string"), 4, "0"), F.year("o_orderdate").cast("string")).alias("fir_no"), F.col("o_orderdate").cast("timestamp").alias("registered_at"))
    found = studies.metadata_facts(T.feed_positions(rows, ["state_code"], ["registered_at", "case_id"]))
    return found.select("case_id", _r("place"), F.round("hash", 9).alias("hash"), "serial", _r("day"))


DROPOUT = {"1": {"default": 0.1}, "2": {"status": 0.3, "default": 0.05}, "3": {"default": 0.0}}
CONFUSION = {"1": 0.2, "2": 0.0, "3": 0.5}
CONFUSABLE = {"status": [("F", "O"), ("O", "P")], "segment": [("BUILDING", "MACHINERY")]}


@query
def recording_errors(spark, d):
    rows = cases(spark, d).select(F.col("id").alias("case_id"), F.substring("cls", 1, 1).alias("state_code"), "status", "segment")
    return recorded(rows, ["status", "segment"], DROPOUT, CONFUSION, CONFUSABLE, {"3": ["segment"]}, 7).select("case_id", "rec_status", "rec_segment")


@query
def cumulative_offsets(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    found = T.running(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], {"offset": F.col("event_id") % 17})
    return found.select("event_id", "user_id", "offset", F.col("offset_all").alias("span"))


@query
def drawn_values(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", uniform(7, "value", "o_orderkey").alias("u"))
    return rows.select("o_orderkey", _r("u"), T.cdf_draw(F.col("u"), {"night": 0.5, "day": 0.3, "early": 0.2}).alias("value"))


@query
def applicable_fields(spark, d):
    spec = LinkageSpec(fields=tuple(FieldSpec(f, section=CORE if f in VOCABULARY.core else EXT, families=tuple(VOCABULARY.families_with(f) or ())) for f in VOCABULARY.every), family_of=VOCABULARY.family_of)
    return spark.createDataFrame([(cls, k, f) for cls in VOCABULARY.classes for k, f in enumerate(spec.applicable(cls), 1)], "cls string, place long, field string")


@query
def tilted_chances(spark, d):
    one = ValueModel(("a", "b", "c"), (0.5, 0.3, 0.2), ((1.0, 0.0), (0.0, -1.0), (0.5, 0.5)))
    many = ValueModel(("t", "u", "v"), (0.1, 0.6, 1.0), one.loading, True)
    style = np.array([0.8, -0.4])
    rows = [(kind, tau, v, float(p)) for kind, m in (("one", one), ("many", many)) for tau in (0.0, 0.75) for v, p in zip(m.values, m.tilted(style, tau))]
    return spark.createDataFrame(rows, "kind string, tau double, value string, p double").withColumn("p", F.round("p", 9))


# The service


@query
def serve_case(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("crime_type"), F.lit("META").alias("sk"), F.col("o_custkey").alias("pii_ref"), F.lit(True).alias("needs_enrichment"), F.lit("x").alias("crime_type_year_quarter"), F.col("o_orderkey").alias("fir_no"), F.col("o_orderdate").cast("timestamp").alias("registered_at"))
    status, found = serve.get_case(rows, CASE)
    unknown, _ = serve.get_case(rows, -1)
    return serve.case_record(found).withColumns({"status": F.lit(status).cast("long"), "unknown": F.lit(unknown).cast("long")})


@query
def serve_links(spark, d):
    rows, links = cases(spark, d).select(F.col("id").alias("case_id")), _ranked(spark, d)
    made = None
    for scope, limit in (("same", 5), ("all", 10)):
        status, found = serve.get_links(rows, links, CASE, scope, limit)
        part = found.select(F.lit(scope).alias("scope"), F.lit(status).cast("long").alias("status"), "partner_id", "rank", "total_bits", "pair_class", F.array_join("driven_by", "; ").alias("driven_by"))
        made = part if made is None else made.union(part)
    return made


@query
def serve_cluster(spark, d):
    near = _vectors(spark, d).select(F.col("case_id").alias("id_a"), F.col("partner_id").alias("id_b"), F.col("sim").alias("total_bits"))
    found = graph.clusters(near, CLUSTER_SIM).withColumn("members", F.col("members"))
    return serve.clusters_of(found, CASE).select("cluster_id", "size", "edges")


@query
def feedback_post(spark, d):
    path = shared_path(spark, "feedback")
    bodies = [("a", "b", "confirmed", "same tool"), ("b", "a", "rejected", "other town"), ("a", "c", "maybe", "x"), ("a", "d", "unsure", "  "), ("", "d", "unsure", "y")]
    said = [serve.post_feedback(spark, path, "me", dict(zip(("case_id_a", "case_id_b", "status", "reason"), b)))[0] for b in bodies]
    kept = spark.read.parquet(path).select("pair_id", F.col("status").alias("judgement"), "actor_id")
    return kept.withColumn("codes", F.lit(",".join(map(str, said))))


@query
def pii_gate(spark, d):
    path = shared_path(spark, "audit")
    pii = table(spark, d, "customer").select(F.col("c_custkey").alias("pii_ref"), "c_name")
    codes = [serve.request_pii(spark, pii, path, "me", 3, reason)[0] for reason in (None, "  ", "court order")]
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n")).withColumn("codes", F.lit(",".join(map(str, codes))))


@query
def role_matrix(spark, d):
    names = sorted({t for reached in serve.ROLES.values() for t in reached})
    return spark.createDataFrame([(role, t, serve.reaches(role, t)) for role in serve.ROLES for t in names], "role string, store string, reached boolean")


