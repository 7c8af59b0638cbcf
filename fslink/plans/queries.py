"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.functions import evidence as E
from fslink.functions import text as X
from fslink.operators import frequencies as Q
from fslink.operators import graph, knn, metrics, model, studies
from fslink.operators import normalise as N
from fslink.operators import render as R
from fslink.operators import scoring as S
from fslink.operators import statistics as T
from fslink.plans.views import ALPHA_CROSS, ALPHA_SAME, SPEC, cases, table
from fslink.sources.shared import settle, shared_path
from fslink.sources.tables import latest
from fslink.spec import CROSS_TYPE, SAME_FAMILY, SAME_TYPE, LinkageSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STATUS_LABELS = {"O": "open", "F": "final", "P": "partial"}
SCOPE = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
FLAG_LABELS = {"A": "accepted", "N": N.NONE_OBSERVED, "R": "returned"}
PHRASES = {"tools": {"with": {"en": "with"}, "from": {"en": "from"}, N.NONE_OBSERVED: {"en": "the"}}, "mode": {"on": {"en": " on "}, "the": {"en": "the"}}}
TOP = 50
CLUSTER_SIM = 0.35


#: Counts and places that SQL engines give as 64-bit integers.
LONGS = {"year", "replicate", "place", "step", "n", "rank", "retrieval_rank", "serial", "position", "size", "edges", "total"}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = f(spark, sf_dir)
        wide = [c for c, kind in found.dtypes if c in LONGS and kind == "int"]
        return found.withColumns({c: F.col(c).cast("long") for c in wide}) if wide else found

    QUERIES[f.__name__] = run
    return run


def _r(column: str):
    return F.round(column, 6).alias(column)


# Normalisation


@query
def normalise_labels(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", N.lookup(F.col("o_orderstatus"), STATUS_LABELS).alias("status"))


@query
def scope_drop(spark, d):
    return N.in_scope(table(spark, d, "orders"), "o_orderpriority", SCOPE).select("o_orderkey", "crime_type")


@query
def tag_split(spark, d):
    raw = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("raw"))
    return raw.select("l_orderkey", F.array_join(N.split_tags(F.col("raw"), "|", FLAG_LABELS), ";").alias("tags"))


@query
def native_rendering(spark, d):
    v = N.Vocabulary({}, {"flags": {value: {"X": value.upper(), "en": value} for value in ("accepted", "returned", N.NONE_OBSERVED)}, "status": {value: {"X": code} for code, value in STATUS_LABELS.items()}}, {}, ("status", "flags"), {}, frozenset({"flags"}))
    feed = N.Feed("X", {}, delimiter=" / ")
    tags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", N.lookup(F.col("l_returnflag"), FLAG_LABELS)))), ";").alias("tags"))
    rows = table(spark, d, "orders").join(tags, "o_orderkey", "left").select("o_orderkey", "tags", N.lookup(F.col("o_orderstatus"), STATUS_LABELS).alias("status"))
    return rows.select("o_orderkey", R.native_cell(F.col("status"), "status", feed, v).alias("status_cell"), R.native_cell(F.col("tags"), "flags", feed, v).alias("flags_cell"))


@query
def case_id_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.case_id(F.col("o_orderpriority"), F.col("o_orderkey"), F.year("o_orderdate")).alias("case_id"))


@query
def time_band(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("ts").alias("a"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor(F.abs("value") * 900) * 1000000).cast("long")).alias("b"))
    vocabulary = N.Vocabulary({}, {}, {}, (), {})
    return events.select("event_id", N.time_band(F.col("a"), F.col("b"), vocabulary.bands, 12).alias("band"))


@query
def year_quarter(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.year_quarter(F.col("o_orderpriority"), F.col("o_orderdate")).alias("key"))


@query
def phrase_extract(spark, d):
    v = N.Vocabulary({}, PHRASES, {}, ("tools", "mode"), {}, frozenset({"tools"}))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(N.extracted(F.col("text"), "tools", v), ";").alias("tools"), N.extracted(F.col("text"), "mode", v).alias("mode"))


# Frequencies and priors


def _pool(spark, d, pool, tags=False):
    u = Q.frequencies(cases(spark, d), SPEC).where((F.col("pool") == pool) & (F.col("kind") == ("tags" if tags else "categorical")))
    return u.select("key", "field", "value", "n", "total", _r("u"))


@query
def u_by_class(spark, d):
    return _pool(spark, d, SAME_TYPE)


@query
def u_by_family(spark, d):
    return _pool(spark, d, SAME_FAMILY)


@query
def u_pooled(spark, d):
    return _pool(spark, d, CROSS_TYPE)


@query
def u_tags(spark, d):
    return _pool(spark, d, SAME_TYPE, True)


@query
def u_window(spark, d):
    return Q.shares_by_window(cases(spark, d), "cls", "status").select("cls", "status", "n", _r("u"))


@query
def u_grouping_sets(spark, d):
    return Q.shares_by_grouping_sets(cases(spark, d), "cls", "segment")


@query
def field_aggregate(spark, d):
    found = Q.field_aggregates(Q.frequencies(cases(spark, d), SPEC), ALPHA_SAME)
    return found.select("pool", "key", "field", _r("u_field"), _r("m_field"))


@query
def weights_table(spark, d):
    u = Q.frequencies(cases(spark, d), SPEC)
    m = E.m_of(F.col("u"), ALPHA_SAME)
    return u.select("pool", "key", "field", "value", F.round(m, 6).alias("m"), F.round(E.agreement_bits(m, F.col("u")), 6).alias("agree_bits"), F.round(E.disagreement_bits(m, F.col("u")), 6).alias("disagree_bits"))


@query
def prior_bits(spark, d):
    return Q.priors(cases(spark, d), SPEC).select("pair_class", "key", "true_pairs", "all_pairs", _r("prior"))


@query
def pair_stats(spark, d):
    return T.pair_stats(cases(spark, d), "entity", "cls", "quarter")


@query
def cross_repeat_rate(spark, d):
    return Q.cross_repeat_rate(cases(spark, d), SPEC).select("agreed", "compared", _r("rate"))


# Pairs


@query
def true_pairs(spark, d):
    return Q.true_pairs(cases(spark, d), SPEC)


def _scored(spark, d):
    c = settle(cases(spark, d))
    pairs = settle(Q.true_pairs(c, SPEC).select("id_a", "id_b"))
    return c, pairs, S.contributions(pairs, c, Q.frequencies(c, SPEC), SPEC, ALPHA_SAME, ALPHA_CROSS)


@query
def pair_contributions(spark, d):
    return _scored(spark, d)[2].select("id_a", "id_b", "pair_class", "field", "value_a", "value_b", _r("bits"))


@query
def pair_totals(spark, d):
    c, pairs, scored = _scored(spark, d)
    return S.totals(pairs, c, scored, Q.priors(c, SPEC), SPEC).select("id_a", "id_b", "pair_class", _r("prior_bits"), _r("total_bits"))


@query
def feature_vector(spark, d):
    found = S.collapsed(_scored(spark, d)[2], SPEC)
    return found.select("id_a", "id_b", *(_r(f.name) for f in SPEC.fields))


@query
def driven_by(spark, d):
    scored = _scored(spark, d)[2]
    return S.driven_by(scored.withColumn("bits", F.round("bits", 6)))


@query
def waterfall(spark, d):
    c, pairs, scored = _scored(spark, d)
    scored = scored.withColumn("bits", F.round("bits", 6))
    steps = S.waterfall(scored, S.totals(pairs, c, scored, Q.priors(c, SPEC), SPEC))
    return steps.select("id_a", "id_b", "step", "field", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


# Text


@query
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"), F.element_at(X.tokens(F.concat(F.col("text"), F.lit(" end"))), 1).alias("first"))


@query
def ngrams(spark, d):
    made = table(spark, d, "documents").select("doc_id", X.ngrams(X.tokens(F.col("text"))).alias("g"))
    return made.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("digest"))


@query
def fnv_buckets(spark, d):
    terms = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.fnv1a(F.col("term")).alias("hash"), X.bucket(F.col("term")).alias("bucket"))


def _counts(spark, d, high=2):
    return settle(X.document_counts(table(spark, d, "documents"), "doc_id", "text", high=high))


def _idf(counts):
    return X.idf(counts.select("doc_id", F.inline("counts")), counts.agg(F.count("*").alias("n")), "doc_id", 0.9)


@query
def idf(spark, d):
    return _idf(_counts(spark, d, 1)).select("bucket", "df", _r("idf"))


@query
def idf_ngrams(spark, d):
    return _idf(_counts(spark, d)).select("bucket", "df", _r("idf"))


def _weights(counts):
    return X.weighted(counts, _idf(counts), "doc_id", True).select("doc_id", F.inline("weights")).select("doc_id", "bucket", _r("weight"))


@query
def tfidf_weights(spark, d):
    return _weights(_counts(spark, d, 1))


@query
def tfidf_weights_ngrams(spark, d):
    return _weights(_counts(spark, d))


@query
def text_topk(spark, d):
    counts = _counts(spark, d)
    return knn.top_k(X.vectors(counts, _idf(counts), "doc_id", sublinear=True), TOP, "doc_id", "vector").select("case_id", "partner_id", "sim", "retrieval_rank")


def _vectors(spark, d, k=TOP):
    return knn.top_k(table(spark, d, "embeddings"), k, "vec_id", "embedding")


@query
def vector_topk(spark, d):
    return _vectors(spark, d).select("case_id", "partner_id", "sim", "retrieval_rank")


# Links, clusters


def _links(spark, d):
    c = settle(cases(spark, d))
    near = settle(_vectors(spark, d))
    pairs = near.select(F.col("case_id").alias("id_a"), F.col("partner_id").alias("id_b"))
    scored = S.contributions(pairs, c, Q.frequencies(c, SPEC), SPEC, ALPHA_SAME, ALPHA_CROSS)
    total = S.totals(pairs, c, scored, Q.priors(c, SPEC), SPEC).select(F.col("id_a").alias("case_id"), F.col("id_b").alias("partner_id"), "pair_class", "prior_bits", F.round("total_bits", 6).alias("total_bits"))
    return S.ranked(near.join(total, ["case_id", "partner_id"])), scored


@query
def links(spark, d):
    return _links(spark, d)[0].select("case_id", "partner_id", "rank", "total_bits", _r("prior_bits"), "pair_class")


@query
def links_with_contributions(spark, d):
    ranked, scored = _links(spark, d)
    full = S.with_contributions(ranked, scored.withColumn("bits", F.round("bits", 6)))
    return full.select("case_id", "partner_id", F.array_join(F.transform("contributions", lambda x: x["field"]), ",").alias("fields"))


@query
def links_scope(spark, d):
    return S.scoped(_links(spark, d)[0], 7, SAME_TYPE, 5).select("case_id", "partner_id", "rank", "total_bits")


@query
def bits_sort_key(spark, d):
    return S.sort_keys(_links(spark, d)[0]).select("case_id", "partner_id", "sk")


@query
def clusters(spark, d):
    near = _vectors(spark, d).select(F.col("case_id").alias("id_a"), F.col("partner_id").alias("id_b"), F.col("sim").alias("total_bits"))
    return graph.clusters(near, CLUSTER_SIM).select("cluster_id", F.array_join("members", ",").alias("members"), "size", "edges", F.round("mean_bits", 9).alias("mean_bits"))


@query
def ego_cluster(spark, d):
    ranked, _ = _links(spark, d)
    return graph.ego_cluster(ranked, cases(spark, d), "id", "happened", "quarter", 7, 0.0).select("member", "place", "relocated")


# Metrics


def _labelled(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("entity"), (F.col("vec_id") % 2).cast("string").alias("cls"))
    return vectors


def _pairs_of_labels(spark, d):
    return Q.true_pairs(_labelled(spark, d), LinkageSpec(id="vec_id", cls="cls", entity="entity"))


@query
def recall_at_k(spark, d):
    return metrics.recall_of_groups(_labelled(spark, d), LinkageSpec(id="vec_id", cls="cls", entity="entity"), _vectors(spark, d), TOP).select("pair_class", "queries", _r("recall"))


@query
def entity_recall(spark, d):
    return metrics.entity_recall(_pairs_of_labels(spark, d), _vectors(spark, d), TOP).select("entities", _r("recall"))


def _candidates(spark, d):
    near = _vectors(spark, d)
    pairs = near.groupBy(F.least("case_id", "partner_id").alias("id_a"), F.greatest("case_id", "partner_id").alias("id_b")).agg(F.max("sim").alias("score"))
    v = _labelled(spark, d)
    side = lambda x: v.select(F.col("vec_id").alias(f"id_{x}"), F.col("entity").alias(f"e_{x}"), F.col("cls").alias(f"c_{x}"))
    rows = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    return rows.select("id_a", "id_b", F.when(F.col("c_a") == F.col("c_b"), SAME_TYPE).otherwise(CROSS_TYPE).alias("pair_class"), (F.col("e_a") == F.col("e_b")).cast("int").alias("label"), "score")


@query
def precision_at_k(spark, d):
    return metrics.precision_at_k(_candidates(spark, d), 10).select("pair_class", "queries", _r("precision"))


@query
def pr_auc(spark, d):
    return metrics.pr_auc(_candidates(spark, d)).select("pair_class", "positives", "pairs", F.round("pr_auc", 9).alias("pr_auc"))


# Statistics


@query
def mutual_information(spark, d):
    return T.mutual_information(cases(spark, d), "cls", "status", "segment").select("cls", "n", F.round("mi_bits", 8).alias("mi_bits"))


def _expected(spark):
    return spark.createDataFrame([(c, v, 1 / 3) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for v in ("O", "F", "P")], "cls string, value string, p double")


@query
def z_scores(spark, d):
    return T.realised(cases(spark, d), "cls", "status", _expected(spark)).select("cls", "value", "n", _r("observed"), _r("expected"), F.round("z", 4).alias("z"))


@query
def drift(spark, d):
    found = T.realised(cases(spark, d), "cls", "status", _expected(spark)).withColumn("drift", F.round("drift", 6))
    return T.largest_drift(found).select("cls", "value", "drift")


@query
def dispersion(spark, d):
    return T.dispersion(cases(spark, d), "entity").select("entities", F.round("index", 6).alias("dispersion_index"), _r("top_tenth_share"))


@query
def recording_rates(spark, d):
    rows = cases(spark, d).withColumn("said", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, "X").otherwise(F.col("status")))
    return T.recording_rates(rows, "region", {"said": "status"}).select("place", "field", "n", _r("recorded"), _r("confused"))


@query
def first_per_entity(spark, d):
    return T.first_per(cases(spark, d), ["entity", "cls"], ["happened", "id"]).select("entity", "cls", "id")


@query
def dedupe_pairs(spark, d):
    near = _vectors(spark, d).select(F.col("case_id").alias("id_a"), F.col("partner_id").alias("id_b"), "retrieval_rank")
    return T.unordered_pairs(near, "retrieval_rank")


@query
def serial_number(spark, d):
    rows = cases(spark, d).withColumn("year", F.year("happened"))
    return T.serial_numbers(rows, ["status", "year"], ["happened", "id"]).select("id", "status", "year", "serial")


@query
def feed_position(spark, d):
    return T.feed_positions(cases(spark, d), ["segment"], ["happened", "id"]).select("id", "position", "total")


@query
def relocated(spark, d):
    return T.relocated_entities(cases(spark, d), "id", "entity", "quarter", "happened")


# Model


@query
def entity_split(spark, d):
    return model.entity_split(cases(spark, d), "entity")


@query
def permutation_null(spark, d):
    return T.permutation_null(cases(spark, d), "id", "cls", "status", "segment").select("replicate", "cls", "n", F.round("mi_bits", 8).alias("mi_bits"))


@query
def summed_information(spark, d):
    found = studies.excess_information(cases(spark, d), "id", "cls", ["status", "segment", "quarter", "region"])
    return found.select(*(_r(c) for c in ("observed", "null_mean", "null_max", "excess")))


# Sources, streams


@query
def scan_parquet(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query
def feedback_latest(spark, d):
    return latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query
def stream_ingest(spark, d):
    from fslink.streaming.ingest import file_stream, ingest

    events = table(spark, d, "events")
    base = shared_path(spark, "stream")
    run = ingest(file_stream(spark, d, events.schema, glob="events.parquet"), f"{base}/cases", f"{base}/state", "event_id", lambda df: df.where("value > 0"))
    run.awaitTermination()
    return spark.read.parquet(f"{base}/cases").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
