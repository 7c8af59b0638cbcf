"""From cases to ranked links, and from links to trained and judged models.

``Context`` holds what all of it shares, computed once: cases, frequencies, priors, both alphas, the
nearest neighbours by text and the split of the entities.  Another embedder takes the place of the
default without anything else being computed anew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.functions.evidence import alpha_of, bits_sort_key
from fslink.operators import frequencies as Q
from fslink.operators import knn, metrics, model
from fslink.operators import scoring as S
from fslink.operators.embed import Embedder, embed
from fslink.sources.shared import settle
from fslink.spec import CROSS_TYPE, SAME_TYPE, LinkageSpec

TOP = 50
KS = (50, 200, 500)
BEST = 10
CLASSES = (SAME_TYPE, CROSS_TYPE)


@dataclass(frozen=True)
class Context:
    """``near`` has case_id, partner_id, sim and retrieval_rank; ``split`` entity and split."""

    spec: LinkageSpec
    cases: DataFrame
    u: DataFrame
    priors: DataFrame
    alpha_same: float
    alpha_cross: float
    near: DataFrame
    split: DataFrame

    def with_embedder(self, embedder: Embedder, k: int = TOP) -> Context:
        return replace(self, near=neighbours(self.cases, self.spec, embedder, k))


def neighbours(cases: DataFrame, spec: LinkageSpec, embedder: Embedder | None = None, k: int = TOP) -> DataFrame:
    """The k nearest others of every case by its text."""
    return settle(knn.top_k(embed(cases, spec.id, spec.text, embedder), k, spec.id, "vector"))


def cross_alpha(cases: DataFrame, spec: LinkageSpec, alpha_same: float, reference_frequency: float) -> float:
    """The alpha of pairs of two classes, from how often entities repeat themselves across classes; that
    of one class where they don't repeat beyond the reference frequency."""
    rate = Q.cross_repeat_rate(cases, spec).first()["rate"]
    return alpha_of(rate, reference_frequency) if rate and rate > reference_frequency else alpha_same


def context(cases: DataFrame, spec: LinkageSpec, alpha_same: float, reference_frequency: float = 0.1, embedder: Embedder | None = None, k: int = TOP, seed: int = 7, near: DataFrame | None = None) -> Context:
    """Everything that linking, training and judging share.  ``near`` takes ready neighbours."""
    cases = settle(cases)
    found = near if near is not None else neighbours(cases, spec, embedder, k)
    return Context(spec, cases, settle(Q.frequencies(cases, spec)), settle(Q.priors(cases, spec)), alpha_same, cross_alpha(cases, spec, alpha_same, reference_frequency), found, settle(model.entity_split(cases, spec.entity, seed)))


def link(made: Context) -> DataFrame:
    """Ranked directed links with their contributions: case_id, partner_id, rank, total_bits,
    prior_bits, pair_class, sim, retrieval_rank, contributions (with each side's provenance, if the
    cases have field_provenance)."""
    pairs = settle(made.near.select(F.col("case_id").alias("id_a"), F.col("partner_id").alias("id_b")))
    scored = settle(S.contributions(pairs, made.cases, made.u, made.spec, made.alpha_same, made.alpha_cross))
    totals = S.totals(pairs, made.cases, scored, made.priors, made.spec)
    totals = totals.select(F.col("id_a").alias("case_id"), F.col("id_b").alias("partner_id"), "pair_class", F.round("prior_bits", 6).alias("prior_bits"), F.round("total_bits", 6).alias("total_bits"))
    links = S.with_contributions(S.ranked(made.near.join(totals, ["case_id", "partner_id"])), scored.withColumn("bits", F.round("bits", 6)))
    if "field_provenance" in made.cases.columns:
        links = _with_provenance(links, made.cases, made.spec)
    return links


def _with_provenance(links: DataFrame, cases: DataFrame, spec: LinkageSpec) -> DataFrame:
    said = lambda key, name: cases.select(F.col(spec.id).alias(key), F.col("field_provenance").alias(name))
    both = links.join(said("case_id", "said_a"), "case_id").join(said("partner_id", "said_b"), "partner_id")
    base = lambda x: F.split_part(x["field"], F.lit(":"), F.lit(1))
    of = lambda name, x: F.try_element_at(F.col(name), base(x))
    told = F.transform("contributions", lambda x: x.withField("provenance", F.struct(of("said_a", x).alias("a"), of("said_b", x).alias("b"))))
    return both.withColumn("contributions", told).drop("said_a", "said_b")


def link_batch(cases: DataFrame, spec: LinkageSpec, alpha_same: float, reference_frequency: float = 0.1, embedder: Embedder | None = None, k: int = TOP, sink: str | None = None) -> DataFrame:
    """All cases linked; written to ``sink`` (Parquet, sorted by case and sort key) if one is named."""
    links = link(context(cases, spec, alpha_same, reference_frequency, embedder, k))
    if sink is None:
        return links
    keyed = links.withColumn("sk", bits_sort_key(F.col("total_bits"), F.col("partner_id")))
    keyed.repartitionByRange("case_id").sortWithinPartitions("case_id", "sk").write.mode("overwrite").parquet(sink)
    return links.sparkSession.read.parquet(sink)


def candidates(made: Context) -> DataFrame:
    """One row per unordered pair of neighbours: id_a, id_b, pair_class, label, a column of bits per
    field of the spec, prior_bits (0 where unknown) and raw, their sum."""
    spec = made.spec
    names = [f.name for f in spec.fields]
    pairs = settle(made.near.select(F.least("case_id", "partner_id").alias("id_a"), F.greatest("case_id", "partner_id").alias("id_b")).distinct())
    scored = settle(S.contributions(pairs, made.cases, made.u, spec, made.alpha_same, made.alpha_cross))
    totals = S.totals(pairs, made.cases, scored, made.priors, spec).select("id_a", "id_b", "pair_class", F.coalesce("prior_bits", F.lit(0.0)).alias("prior_bits"))
    side = lambda x: made.cases.select(F.col(spec.id).alias(f"id_{x}"), F.col(spec.entity).alias(f"entity_{x}"))
    labelled = totals.join(side("a"), "id_a").join(side("b"), "id_b").withColumn("label", F.coalesce((F.col("entity_a") == F.col("entity_b")).cast("int"), F.lit(0)))
    wide = labelled.join(S.collapsed(scored, spec), ["id_a", "id_b"], "left").na.fill(0.0, names)
    return wide.select("id_a", "id_b", "pair_class", "label", *names, "prior_bits", sum((F.col(n) for n in names), F.col("prior_bits")).alias("raw"))


def within(made: Context, pairs: DataFrame, part: str) -> DataFrame:
    """The pairs with both cases' entities in a part of the split."""
    return model.pairs_within(pairs, made.split, made.cases.select(F.col(made.spec.id).alias("id"), F.col(made.spec.entity).alias("entity")), part)


def train(made: Context, table: DataFrame | None = None) -> dict:
    """One model per pair class, fitted on the training part and calibrated on its own part; with one
    label only all coefficients are 0 and there is no calibration.  Ready for JSON."""
    table = settle(candidates(made)) if table is None else table
    training, aside = settle(within(made, table, "train")), settle(within(made, table, "calib"))
    names = [*(f.name for f in made.spec.fields), "prior_bits"]
    models = {}
    for cls in CLASSES:
        fitted = model.fit(training.where(F.col("pair_class") == cls), names)
        apart = aside.where(F.col("pair_class") == cls)
        models[cls] = fitted | {"calibration": model.calibrate(apart, fitted) if any(fitted["coef"]) else None}
    return model.export(models, made.alpha_same, made.alpha_cross)


def scores(table: DataFrame, weights: dict) -> DataFrame:
    """The candidates with ``score``: the model's of their class, the raw sum where it has none."""
    score = F.col("raw")
    for cls in CLASSES:
        if any(weights[cls]["coef"]):
            score = F.when(F.col("pair_class") == cls, model.linear_score(weights[cls])).otherwise(score)
    return table.withColumn("score", score)


def evaluate(made: Context, weights: dict, table: DataFrame | None = None, k: int = TOP, best: int = BEST) -> DataFrame:
    """A row per pair class over the part of the entities kept for testing: true_pairs, queries,
    recall, entity_recall (over both classes), candidates, positives, precision, pr_auc."""
    table = settle(candidates(made)) if table is None else table
    scored = settle(scores(within(made, table, "test"), weights))
    truth = settle(within(made, Q.true_pairs(made.cases, made.spec), "test"))
    parts = [
        truth.groupBy("pair_class").agg(F.count("*").alias("true_pairs")),
        metrics.recall_at_k(truth, made.near, k),
        scored.groupBy("pair_class").agg(F.count("*").alias("candidates"), F.sum("label").alias("positives")),
        metrics.precision_at_k(scored, best).select("pair_class", "precision"),
        metrics.pr_auc(scored).select("pair_class", "pr_auc"),
    ]
    rows = made.cases.sparkSession.createDataFrame([(c,) for c in CLASSES], "pair_class string")
    for part in parts:
        rows = rows.join(part, "pair_class", "left")
    entities = metrics.entity_recall(truth, made.near, k).select(F.col("recall").alias("entity_recall"))
    return rows.join(entities).select("pair_class", "true_pairs", "queries", "recall", "entity_recall", "candidates", "positives", "precision", "pr_auc")


def recall_at_ks(made: Context, near: DataFrame, ks: tuple[int, ...] = KS, part: str | None = "test") -> DataFrame:
    """(k, pair_class, queries, recall) of neighbours as deep as the largest k."""
    truth = Q.true_pairs(made.cases, made.spec)
    truth = settle(within(made, truth, part) if part else truth)
    found = None
    for k in ks:
        one = metrics.recall_at_k(truth, near, k).select(F.lit(k).cast("long").alias("k"), "pair_class", "queries", "recall")
        found = one if found is None else found.union(one)
    return found


def compare_embedders(made: Context, embedders: dict[str, Embedder], ks: tuple[int, ...] = KS) -> DataFrame:
    """(embedder, k, pair_class, queries, recall) of each embedder over the same cases and split."""
    found = None
    for name, embedder in embedders.items():
        near = neighbours(made.cases, made.spec, embedder, max(ks))
        one = recall_at_ks(made, near, ks).select(F.lit(name).alias("embedder"), "*")
        found = one if found is None else found.union(one)
    return found


def relink(read, spec: LinkageSpec, alpha_same: float, folder: str, version: str, **how) -> DataFrame:
    """The scheduled full run: everything that ``read()`` gives is linked anew into
    ``folder/version=...``; readers of the latest version see either the old links or the new ones, never
    a mixture.  The scheduler (cron, a workflow) calls it."""
    return link_batch(read(), spec, alpha_same, sink=f"{folder}/version={version}", **how)


def latest_links(spark, folder: str) -> DataFrame:
    """The links of the greatest version that was written to its end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in store.listStatus(root) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done))
