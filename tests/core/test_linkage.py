"""The linkage core against literal cases, definitions and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fslink import serve
from fslink.functions import evidence as E
from fslink.functions import text as X
from fslink.operators import frequencies as Q
from fslink.operators import graph, knn, metrics, model
from fslink.operators import scoring as S
from fslink.operators import statistics as T
from fslink.plans.queries import QUERIES
from fslink.sources import files, tables
from fslink.spec import EXT, TAGS, FieldSpec, LinkageSpec

SPEC = LinkageSpec(id="id", cls="cls", entity="entity", fields=(FieldSpec("band"), FieldSpec("tools", TAGS), FieldSpec("door", section=EXT, families=("house",))), family_of={"home": "house", "shop": "house"})
CASES = [
    (1, "home", "e1", "night", ["c", "k"], "roof"),
    (2, "home", "e1", "night", ["c"], "roof"),
    (3, "home", "e2", None, ["c", "k", "g"], "wall"),
    (4, "home", "e2", "day", [], None),
    (5, "shop", "e1", "day", None, "roof"),
    (6, "car", "e3", "night", ["k"], "roof"),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, "id long, cls string, entity string, band string, tools array<string>, door string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bits(spark):
    u = F.lit(0.06)
    assert one(spark, E.agreement_bits(E.m_of(u, 7.05), u)) == pytest.approx(1.559, abs=0.05)
    uf = 0.22**2 + 0.58**2 + 0.20**2
    mf = sum(x * (7.05 * x + 1) / 8.05 for x in (0.22, 0.58, 0.20))
    assert one(spark, E.disagreement_bits(F.lit(mf), F.lit(uf))) == pytest.approx(-0.191, abs=0.05)
    assert one(spark, E.disagreement_bits(F.lit(1.0), F.lit(1.0))) is None and one(spark, E.agreement_bits(F.lit(0.5), F.lit(0.0))) is None
    assert one(spark, E.m_of(F.lit(0.3), 0.0)) == 1.0 and one(spark, E.m_of(F.lit(0.3), 1e12)) == pytest.approx(0.3)
    assert E.alpha_of(0.5, 0.1) == pytest.approx(1.25)
    assert one(spark, E.prior_bits(F.lit(0), F.lit(10))) is None and one(spark, E.prior_bits(F.lit(1), F.lit(5))) == -2


def test_sort_key(spark):
    keys = [one(spark, E.bits_sort_key(F.lit(b), F.lit("p"))) for b in (1000.0, 10.0, 2.0, -5.0, -1000.0)]
    assert keys == sorted(keys) and keys[0] == "000000#p" and keys[-1] == "999999#p"


def test_frequencies(cases):
    u = {(r.pool, r.key, r.field, r.value): r.u for r in Q.frequencies(cases, SPEC).collect()}
    assert u["same_type", "home", "band", "night"] == pytest.approx(2 / 3) and u["same_type", "home", "band", "day"] == pytest.approx(1 / 3)
    assert [u["same_type", "home", "tools", t] for t in "ckg"] == [0.75, 0.5, 0.25]
    assert u["same_family", "house", "door", "roof"] == pytest.approx(3 / 4) and ("same_family", "car", "door", "roof") not in u
    assert u["cross_type", "", "band", "night"] == pytest.approx(3 / 5)


def test_priors_equal_listed_pairs(cases):
    got = {(r.pair_class, r.key): (r.true_pairs, r.all_pairs) for r in Q.priors(cases, SPEC).collect()}
    pairs = [(a, b) for i, a in enumerate(CASES) for b in CASES[i + 1 :]]
    assert got["all", ""] == (sum(a[2] == b[2] for a, b in pairs), len(pairs))
    assert got["cross_type", ""] == (sum(a[2] == b[2] and a[1] != b[1] for a, b in pairs), sum(a[1] != b[1] for a, b in pairs))
    assert got["same_type", "home"] == (2, 6)
    rate = Q.cross_repeat_rate(cases, SPEC).first()
    assert (rate.agreed, rate.compared) == (0, 2)


def test_contributions(cases):
    pairs = cases.sparkSession.createDataFrame([(1, 2), (1, 3), (1, 5), (1, 6), (3, 4)], "id_a long, id_b long")
    u = Q.frequencies(cases, SPEC)
    scored = S.contributions(pairs, cases, u, SPEC, 7.05, 20.05)
    got = {(r.id_a, r.id_b, r.field): r for r in scored.collect()}
    m = (7.05 * 2 / 3 + 1) / 8.05
    assert got[1, 2, "band"].bits == pytest.approx(math.log2(m / (2 / 3)))
    assert got[1, 2, "tools:c"].bits > 0 > got[1, 2, "tools:k"].bits and (1, 2, "tools:g") not in got
    assert got[1, 2, "tools:k"].value_a == "True" and got[1, 2, "tools:k"].value_b == "False"
    assert (1, 3, "band") not in got  # no evidence on one side
    assert got[1, 5, "door"].pair_class == "cross_type" and got[1, 5, "door"].bits > 0  # one family, two classes
    assert not any(k[:2] == (1, 6) and k[2] == "door" for k in got)
    total = {(r.id_a, r.id_b): r for r in S.totals(pairs, cases, scored, Q.priors(cases, SPEC), SPEC).collect()}
    row = total[1, 2]
    assert row.total_bits == pytest.approx(row.prior_bits + sum(r.bits for k, r in got.items() if k[:2] == (1, 2)))
    wide = {(r.id_a, r.id_b): r for r in S.collapsed(scored, SPEC).collect()}
    assert wide[1, 2].tools == pytest.approx(got[1, 2, "tools:c"].bits + got[1, 2, "tools:k"].bits)
    steps = S.waterfall(scored, S.totals(pairs, cases, scored, Q.priors(cases, SPEC), SPEC)).where("id_a = 1 and id_b = 2").orderBy("step").collect()
    assert steps[-1].after == pytest.approx(row.total_bits) and all(a.after == pytest.approx(b.before) for a, b in zip(steps, steps[1:]))


def test_text_functions(spark):
    assert one(spark, X.tokens(F.lit("Accused used a CROWBAR!"))) == ["accused", "used", "a", "crowbar"]
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abc")))) == ["a", "b", "c", "a_b", "b_c"]
    h = 2166136261
    for c in b"roof_door":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, X.fnv1a(F.lit("roof_door"))) == h
    words = F.array(*map(F.lit, ["roof", "a", "wall", "x1"]))
    for low, high in ((1, 1), (1, 2), (2, 3), (1, 5)):
        assert one(spark, X.ngram_hashes(words, low, high)) == one(spark, F.transform(X.ngrams(words, low, high), X.fnv1a))
    assert one(spark, X.ngram_hashes(F.array().cast("array<string>"))) == []
    docs = spark.createDataFrame([(1, "roof roof roof roof roof"), (2, "wall door"), (3, "")], "id long, t string")
    counts = X.term_counts(docs, "id", "t", high=1)
    weights = X.tfidf(counts, X.idf(counts, docs.agg(F.count("*").alias("n")), "id"), "id", True)
    vectors = {r.id: r.vector for r in X.dense(weights, docs, "id").collect()}
    assert sum(x * x for x in vectors[1]) == pytest.approx(1) and sum(x * x for x in vectors[2]) == pytest.approx(1) and not any(vectors[3])


def test_registered_text_vectors_use_one_and_two_words(spark, tmp_path):
    texts = {1: "the roof was wet", 2: "wet was the roof", 3: "roof the wet was", 4: "the roof was dry", 5: "", 6: None, 7: "roof"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def hashed(term):
        h = 2166136261
        for c in term.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h % 512

    tf = np.zeros((8, 512))
    for doc, text in texts.items():
        words = (text or "").split()
        for term in [*words, *("_".join(x) for x in zip(words, words[1:]))]:
            tf[doc, hashed(term)] += 1
    df = (tf > 0).sum(0)
    idf = np.where(df / 7 > 0.9, 0.0, np.log(8 / (df + 1)) + 1)
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    length = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / np.where(length > 0, length, 1)
    found = {r.bucket: (r.df, r.idf) for r in QUERIES["idf_ngrams"](spark, str(tmp_path)).collect()}
    assert found.keys() == set(np.flatnonzero(df)) and all(found[b] == (df[b], pytest.approx(idf[b], abs=1e-6)) for b in found)
    weights = {(r.doc_id, r.bucket): r.weight for r in QUERIES["tfidf_weights_ngrams"](spark, str(tmp_path)).collect()}
    assert weights.keys() == {(a, b) for a, b in zip(*np.nonzero(tf))} and all(weights[k] == pytest.approx(w[k], abs=1e-6) for k in weights)
    near = {(r.case_id, r.partner_id): r.sim for r in QUERIES["text_topk"](spark, str(tmp_path)).collect()}
    assert len(near) == 42 and all(near[a, b] == pytest.approx(w[a] @ w[b], abs=1e-4) for a, b in near)
    assert near[1, 2] < 0.9  # the same words in another order


def test_neighbours_are_exact_on_every_path(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "case_id long, vector array<double>")
    sims = np.round(v @ v.T, 6)
    want = []
    for i in range(60):
        near = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        want += [(i, j, k + 1) for k, j in enumerate(near)]
    monkeypatch.setattr(knn, "BLOCK_ROWS", 17)
    for found in (knn.top_k(rows, 5), knn.top_k(rows, 5, broadcast_bytes=0), knn.top_k_sql(rows, 5)):
        assert sorted((r.case_id, r.partner_id, r.retrieval_rank) for r in found.collect()) == sorted(want)
    assert knn.top_k(rows.limit(1), 5).count() == 0


def test_clusters(spark):
    edges = lambda *x: spark.createDataFrame(list(x), "id_a string, id_b string, total_bits double")
    assert [r.members for r in graph.clusters(edges(("a", "b", 15.0), ("b", "c", 12.0))).collect()] == [["a", "b", "c"]]
    assert [r.members for r in graph.clusters(edges(("a", "b", 15.0), ("b", "c", 3.0))).collect()] == [["a", "b"]]
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(16)) and got[101] == 100


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 2, "s", 1, 0.9), (1, 3, "s", 0, 0.8), (2, 4, "s", 1, 0.8), (3, 4, "s", 0, 0.1)], "id_a long, id_b long, pair_class string, label int, score double")
    area = metrics.pr_auc(scored).first().pr_auc
    assert area == pytest.approx(0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)
    assert metrics.pr_auc(scored.where("label = 1")).first().pr_auc is None
    row = metrics.precision_at_k(scored, 1).first()
    assert row.queries == 3 and row.precision == pytest.approx(1.0)
    true = spark.createDataFrame([("e", 1, 2, "s"), ("e", 1, 3, "s")], "entity string, id_a long, id_b long, pair_class string")
    near = spark.createDataFrame([(1, 2, 1), (2, 9, 1), (3, 1, 1)], "case_id long, partner_id long, retrieval_rank int")
    assert metrics.recall_at_k(true, near, 1).first().recall == pytest.approx((0.5 + 0 + 1) / 3)
    assert metrics.entity_recall(true, near, 1).first().recall == pytest.approx(0.5)


def test_ranks_and_scopes(spark):
    links = spark.createDataFrame([(1, 2, "same_type", 3.0, 1), (1, 3, "cross_type", 5.0, 2), (1, 4, "same_type", 3.0, 3)], "case_id long, partner_id long, pair_class string, total_bits double, retrieval_rank int")
    ranked = S.ranked(links)
    assert [(r.partner_id, r["rank"]) for r in S.scoped(ranked, 1, "same_type").collect()] == [(2, 2), (4, 3)]
    with pytest.raises(ValueError):
        S.scoped(ranked, 1, None, 51)


def test_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "p double, q double, label int")
    made = model.fit(rows, ["p", "q"], 1.0)
    w = np.zeros(3)
    design = np.c_[x, np.ones(400)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design.T * (p * (1 - p))) @ design + np.diag([1, 1, 0]), design.T @ (p - y) + w * [1, 1, 0])
    assert made["coef"] == pytest.approx(w[:2], abs=1e-4) and made["bias"] == pytest.approx(w[2], abs=1e-4)
    steps = model.calibrate(rows, made)
    assert steps["y"] == sorted(steps["y"])
    inside = rows.select(model.calibrated(model.linear_score(made), steps).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert 0 <= inside[0] <= inside[1] <= 1
    assert model.fit(rows.where("label = 1"), ["p", "q"])["coef"] == [0.0, 0.0] and model.calibrate(rows.where("label = 1"), made) is None


def test_statistics(spark, cases):
    rows = spark.createDataFrame([("c", str(i % 2), str(i % 2), i) for i in range(100)], "cls string, x string, y string, id long")
    assert T.mutual_information(rows, "cls", "x", "y").first().mi_bits == pytest.approx(1.0)
    null = T.permutation_null(rows, "id", "cls", "x", "y", 20).collect()
    assert len(null) == 20 and max(r.mi_bits for r in null) < 0.3
    assert one(spark, T.z_score(F.lit(0.1), F.lit(0.0), F.lit(10))) == math.inf and one(spark, T.z_score(F.lit(0.0), F.lit(0.0), F.lit(10))) == 0
    assert T.dispersion(cases, "entity").first().entities == 2


def test_tables(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k long, v string, n int")
    assert sorted((r.k, r.v) for r in tables.upsert(base, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    change = spark.createDataFrame([(1, None), (2, "z")], "k long, v string")
    assert sorted((r.k, r.v) for r in tables.update(base, change, "k").collect()) == [(1, "a"), (2, "z")]
    assert tables.latest(base.union(new), ["k"], "n", "v").count() == 3
    many = tables.chunks(spark.range(2500), "id").groupBy("chunk").count().collect()
    assert len(many) == 3 and all(700 < r["count"] < 1000 for r in many)


def test_serving(spark, tmp_path):
    cases = spark.createDataFrame([("c1", "ref", "x")], "case_id string, pii_ref string, district string")
    links = spark.createDataFrame([("c1", "c2", "same_type", 1.0, 1)], "case_id string, partner_id string, pair_class string, total_bits double, rank int")
    status, found = serve.get_case(cases, "c1")
    assert status == 200 and "pii_ref" not in found.columns and serve.get_case(cases, "nope")[0] == 404
    assert serve.get_links(cases, links, "nope")[0] == 404 and serve.get_links(cases, links, "c1", limit=0)[0] == 400 and serve.get_links(cases, links, "c1")[1].count() == 1
    path = str(tmp_path / "feedback")
    good = {"case_id_a": "a", "case_id_b": "b", "status": "confirmed", "reason": "same tool"}
    assert serve.post_feedback(spark, path, "me", good)[0] == 201 and serve.post_feedback(spark, path, "me", good | {"reason": " "})[0] == 400 and serve.post_feedback(spark, path, "me", good | {"status": "maybe"})[0] == 400
    assert spark.read.parquet(path).first().pair_id == "a#b"
    log = str(tmp_path / "audit")
    pii = spark.createDataFrame([("ref", "name")], "pii_ref string, name string")
    assert serve.request_pii(spark, pii, log, "me", "ref", "  ")[0] == 403 and serve.request_pii(spark, pii, log, "me", "ref", "court order")[1].count() == 1
    assert spark.read.parquet(log).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('a,b\n1,\n"x,y",z\n')
    rows = files.read_feed(spark, str(tmp_path / "feed.csv"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [("1", ""), ("x,y", "z")]
    files.dump_model({"a": [1.5]}, str(tmp_path / "m.json"))
    assert files.load_model(str(tmp_path / "m.json")) == {"a": [1.5]}
    (tmp_path / "vocab.yaml").write_text("fields: {a: 1}\n")
    config = files.load_config(str(tmp_path))
    files.publish_config(config, str(tmp_path))
    assert files.load_model(str(tmp_path / "vocab.json")) == {"fields": {"a": 1}}


def test_stream(spark, tmp_path):
    from fslink.streaming.ingest import file_stream, ingest

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(5).write.parquet(source)
    schema = spark.range(1).schema
    for more in (0, 3):
        if more:
            spark.range(3, 8).write.mode("append").parquet(source)
        ingest(file_stream(spark, source, schema), target, state, "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(8))
    # With a time, repeats within the delay are known from the stream's state.
    source, target, state = (str(tmp_path / x) for x in ("in2", "out2", "state2"))
    spark.range(5).withColumn("at", F.timestamp_seconds(F.lit(10**9))).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for more in (0, 3):
        if more:
            spark.range(3, 8).withColumn("at", F.timestamp_seconds(F.lit(10**9 + 60))).write.mode("append").parquet(source)
        ingest(file_stream(spark, source, schema), target, state, "id", at="at").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(8))


def test_inverted_file(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16))
    v = np.concatenate([centre[rng.integers(0, 12, 700)] + rng.normal(0, 0.35, (700, 16)), np.tile(centre[:1], (300, 1)) + rng.normal(0, 0.01, (300, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "case_id long, vector array<double>")
    near = knn.probed_top_k(rows, 5, list_rows=50, checked=100)
    exact = knn.top_k(rows, 5)
    assert near.count() == 5000 and near.join(exact, ["case_id", "partner_id"], "left_semi").count() >= 0.88 * 5000
    sims = {(r.case_id, r.partner_id): r.sim for r in near.collect()}
    assert all(s == pytest.approx(float(np.round(v[a] @ v[b], 6)), abs=2e-6) for (a, b), s in list(sims.items())[:500])
    assert knn.probed_top_k(rows.limit(0), 5).count() == 0 and knn.probed_top_k(rows.limit(1), 5).count() == 0


def test_neighbours_need_no_whole_block_of_similarities(spark):
    # Many rows for few queries: at most blocks of BLOCK_BYTES are held, ties and all.
    import tracemalloc

    rng = np.random.default_rng(4)
    v = np.abs(rng.normal(size=(60_000, 8)))
    v[:9000] = v[0]
    v[100] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    ids = rng.permutation(60_000)
    tracemalloc.start()
    found = knn._neighbours(ids[:1000], v[:1000], ids, v, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    for i in (0, 1, 100, 999):
        sims = np.round(v[i] @ v.T, 6) + 0.0
        sims[i] = -np.inf
        assert found[found["case_id"] == ids[i]]["partner_id"].tolist() == ids[np.lexsort((ids, -sims))[:10]].tolist()


def test_stripes_share_few_tasks_and_leave_no_copies(spark, monkeypatch, tmp_path):
    # What is written for the search is a few times the vectors, however many blocks they make.
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "case_id long, vector array<double>")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    written = []
    monkeypatch.setattr(knn, "settle", lambda df, settle=knn.settle: written.append(settle(df)) or written[-1])
    found = knn.top_k(rows, 4, broadcast_bytes=0)
    assert [df.columns for df in written] == [["id", "v"]]
    from pathlib import Path

    assert not Path(written[0].settled_at.removeprefix("file://")).exists()
    assert found.count() == 1200 and found.exceptAll(knn.top_k(rows, 4)).count() == 0
    twice = rows.union(rows.limit(1))
    assert knn.top_k(twice, 4, broadcast_bytes=0).exceptAll(knn.top_k(twice, 4)).count() == 0


def test_a_stripe_counts_what_is_kept_of_each_query(spark, monkeypatch):
    # Short vectors and many neighbours: the k best take far more than the vectors.
    rng = np.random.default_rng(8)
    v = rng.normal(size=(240, 2))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "case_id long, vector array<double>")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    sizes = []
    monkeypatch.setattr(knn, "_kept", lambda shared, *a, kept=knn._kept: sizes.append(len(shared.value[0])) or kept(shared, *a))
    found = knn.top_k(rows, 50, broadcast_bytes=240 * 2 * 8 - 1)
    assert sum(sizes) == 240 and max(sizes) < 100
    assert found.exceptAll(knn.top_k(rows, 50)).count() == 0


def test_recall_counts_pairs_without_listing_them(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 6)) if i % 9 else None, str(i % 3) if i % 7 else None) for i in range(80)]
    c = spark.createDataFrame(rows, "id long, e int, c string")
    spec = LinkageSpec(id="id", cls="c", entity="e")
    near = spark.createDataFrame([(i, int(j), r + 1) for i in range(80) for r, j in enumerate(rng.choice([x for x in range(80) if x != i], 8, replace=False))], "case_id long, partner_id long, retrieval_rank int")
    want = {r.pair_class: (r.queries, r.recall) for r in metrics.recall_at_k(Q.true_pairs(c, spec), near, 5).collect()}
    got = metrics.recall_of_groups(c, spec, near, 5)
    assert "id_a" not in got._jdf.queryExecution().toString()
    assert {r.pair_class: (r.queries, pytest.approx(r.recall)) for r in got.collect()} == want and len(want) == 2
