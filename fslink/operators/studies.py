"""Studies over whole synthetic corpora: correlation left after recording, the choice of tau, leaks
through metadata, and how good the linkage is at each repeat rate.

The loops run over a handful of parameters; everything within them is a DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import combinations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink import linker
from fslink.operators import frequencies as Q
from fslink.operators import generate as G
from fslink.operators import model
from fslink.operators import statistics as T
from fslink.operators.embed import Embedder, HashingTfidf
from fslink.operators.normalise import DERIVED
from fslink.sources.shared import settle
from fslink.spec import SAME_TYPE, TAGS, LinkageSpec

LEAST_ROWS = 50
KEPT = 0.5
LEAK = 0.01
Z_MOST = 4.0
DISPERSED = 1.5
RATES = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
GRID = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5)

Record = Callable[[DataFrame, G.World, int], DataFrame]


# Correlation


def excess_information(rows: DataFrame, id: str, cls: str, fields: dict[str, str] | list[str], times: int = 50, seed: int = 1, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row (observed, null_mean, null_max, excess): the mutual information in bits of all pairs of
    fields within all classes, summed, against the same sum with one side shuffled ``times`` times.

    Each pair of fields within a class is a group; groups of fewer complete rows don't count.
    """
    texts = settle(rows.select(F.col(id).alias("id"), F.col(cls).alias("in"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields))))
    places = list(combinations((f"f{k}" for k in range(len(fields))), 2))
    # Rows are counted by all their fields once; each pair is counted from these.
    counts = settle(texts.groupBy("in", *(f"f{k}" for k in range(len(fields)))).agg(F.count("*").alias("n")))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in enumerate(places)))).alias("p")
    cells = counts.select(F.col("in").alias("cls"), "n", each).select("cls", "n", "p.*").where("x is not null and y is not null").groupBy("pair", "cls", "x", "y").agg(F.sum("n").alias("n"))
    seen = T.information(cells, least_rows, "pair").agg(F.coalesce(F.sum("mi_bits"), F.lit(0.0)).alias("observed"))
    null = T.permuted_information(texts, "id", "in", places, times, seed, least_rows).groupBy("replicate").agg(F.sum("mi_bits").alias("bits"))
    null = null.agg(F.coalesce(F.avg("bits"), F.lit(0.0)).alias("null_mean"), F.coalesce(F.max("bits"), F.lit(0.0)).alias("null_max"))
    return seen.join(null).withColumn("excess", F.col("observed") - F.col("null_mean"))


def correlation(cases: DataFrame, fields: list[str], times: int = 50, seed: int = 1) -> dict:
    """The excess of true and of recorded values over one case per serial entity and class (more would
    share their habits, and look correlated without being so), and whether each stands out: above
    every shuffle, and recorded with at least half of the true excess."""
    one = T.first_per(cases.where("is_serial"), ["entity", "crime_type"], ["series_index"])
    true = excess_information(one, "case_id", "crime_type", fields, times, seed).first()
    said = excess_information(one, "case_id", "crime_type", [f"rec_{f}" for f in fields], times, seed).first()
    kept = said["excess"] / true["excess"] if true["excess"] > 0 else 0.0
    stands = lambda r: r["observed"] > r["null_max"]
    return {"true_excess": true["excess"], "recorded_excess": said["excess"], "kept": kept, "true_passed": stands(true), "recorded_passed": stands(said) and kept >= KEPT}


def worst_drift(world: G.World, tau: float, least_p: float = 0.02) -> tuple[float, str]:
    """The largest relative drift any value of the world may be expected to show at this tau."""
    found = [(0.0, "")]
    for cls, models in world.fields.items():
        for name, m in models.items():
            moved = G.expected_drift(m, tau, world.axes)
            found += [(float(d), f"{cls}.{name}.{v}") for v, p, d in zip(m.values, m.chance, moved) if least_p <= p < 1]
    return max(found, key=lambda x: abs(x[0]))


def select_tau(spark: SparkSession, world: G.World, record: Record, fields: list[str], offenders: int, grid: tuple[float, ...] = GRID, seeds: tuple[int, ...] = (7, 11, 23), times: int = 50) -> dict:
    """The least tau above 0 with which true and recorded values stand out at every seed, and the
    whole grid's figures.  Only serial entities matter here, so no background is made."""
    rows = []
    for tau in grid:
        here = replace(world, tau=tau)
        each = [{"seed": s} | correlation(settle(record(G.truth(spark, here, offenders, 0, s), here, s)), fields, times, s) for s in seeds]
        drift, value = worst_drift(here, tau)
        rows.append({"tau": tau, "passed": all(e["true_passed"] and e["recorded_passed"] for e in each), "expected_drift": drift, "expected_drift_value": value, "seeds": each})
    return {"chosen": next((r["tau"] for r in rows if r["tau"] > 0 and r["passed"]), None), "grid": rows}


# Leaks


def contrasted_pairs(cases: DataFrame, entity: str, id: str, keep: list[str], seed: int = 1, block: int = 1000) -> DataFrame:
    """(label, a, b): all pairs of one entity, and as many of two, made of the same rows.

    A pair of two entities takes its second side from its predecessor in a hash order, within blocks
    of about ``block`` pairs, so no task orders all pairs.
    """
    side = F.struct(id, entity, *keep)
    spec = LinkageSpec(id=id, cls=entity, entity=entity)
    found = Q.true_pairs(cases, spec).select("id_a", "id_b")
    rows = cases.select(F.col(id), side.alias("s"))
    same = found.join(rows.select(F.col(id).alias("id_a"), F.col("s").alias("a")), "id_a").join(rows.select(F.col(id).alias("id_b"), F.col("s").alias("b")), "id_b")
    same = settle(same)
    blocks = max(1, same.count() // block)
    order = Window.partitionBy(F.pmod(F.xxhash64(F.lit(seed), "id_a", "id_b"), F.lit(blocks))).orderBy(F.xxhash64(F.lit(seed + 1), "id_a", "id_b"), "id_a", "id_b")
    other = same.select("a", F.lag("b").over(order).alias("b")).where(f"b is not null and a.{entity} <> b.{entity}")
    return same.select(F.lit(1).alias("label"), "a", "b").unionByName(other.select(F.lit(0).alias("label"), "a", "b"))


def cross_validated_auc(table: DataFrame, features: list[str], folds: int = 5) -> float:
    """Mean area under the ROC of a logistic regression on standardised features, each fold (0, 1,
    ..., in the column ``fold``) scored by a model of the others."""
    spread = table.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    scaled = table.select("label", "fold", *(((F.col(f) - spread[f"m_{f}"]) / (spread[f"s_{f}"] or 1.0)).alias(f) for f in features))
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label")
    found = []
    for k in range(folds):
        made = model.fit(scaled.where(F.col("fold") != k), features, 1.0)
        found.append(area.evaluate(scaled.where(F.col("fold") == k).select(F.col("label").cast("double").alias("label"), model.linear_score(made).alias("score"))))
    return sum(found) / folds


def metadata_facts(cases: DataFrame, *keep: str) -> DataFrame:
    """(case_id, ..., place, hash, serial, day): a case's place in its feed, 0 to 1; its id as a fraction; its
    register number; the day it was registered."""
    return cases.select(
        "case_id", *keep, (F.col("position") / F.greatest("total", F.lit(1))).alias("place"), (F.conv(F.substring("case_id", 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("hash"),
        F.split_part("fir_no", F.lit("/"), F.lit(2)).cast("double").alias("serial"), (F.unix_seconds("registered_at") / 86400).alias("day"),
    )


def leakage(cases: DataFrame, folds: int = 5, seed: int = 1) -> dict:
    """How much position in the feed, the id's hash and the register number tell about entities
    beyond the time between two cases: the AUC that they add, which must stay below 0.01.

    Needs case_id, entity, police_station, fir_no and registered_at, plus position and total of the
    feed (``statistics.feed_positions``).
    """
    facts = metadata_facts(cases, "entity", "police_station")
    pairs = contrasted_pairs(facts, "entity", "case_id", ["police_station", "place", "hash", "serial", "day"], seed)
    gap = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    near = F.when(F.col("a.police_station") == F.col("b.police_station"), F.log1p(gap("serial"))).otherwise(-1.0)
    table = settle(pairs.select("label", F.pmod(F.xxhash64(F.lit(seed), "a.case_id", "b.case_id"), F.lit(folds)).alias("fold"), F.log1p(gap("day")).alias("time"), gap("place").alias("place"), gap("hash").alias("hash"), near.alias("serial")))
    meta = ["place", "hash", "serial"]
    time, both, alone = (cross_validated_auc(table, names, folds) for names in (["time"], ["time", *meta], meta))
    return {"passed": both - time < LEAK, "auc_time": time, "auc_time_and_metadata": both, "auc_metadata": alone, "added": both - time, "pairs": table.count()}


# Linkage at a repeat rate


def as_cases(recorded: DataFrame, spec: LinkageSpec, text: DataFrame | None = None) -> DataFrame:
    """Recorded cases as a case table of the spec: a long id made of the case id's first 60 bits,
    tags as arrays, and the text (from (case_id, text), if given)."""
    value = lambda f: F.when(F.col(f"rec_{f.name}") == "", F.array().cast("array<string>")).otherwise(F.split(f"rec_{f.name}", ";")) if f.kind == TAGS else F.col(f"rec_{f.name}")
    rows = recorded.join(text, "case_id", "left") if text is not None else recorded.withColumn("text", F.concat_ws(" ", *(F.concat(F.lit(f"{f.name}_"), F.col(f"rec_{f.name}")) for f in spec.fields)))
    return rows.select(F.conv(F.substring("case_id", 1, 15), 16, 10).cast("long").alias(spec.id), F.col("crime_type").alias(spec.cls), F.col("entity").alias(spec.entity), F.col("text").alias(spec.text), *(value(f).alias(f.name) for f in spec.fields))


def experiment(cases: DataFrame, spec: LinkageSpec, alpha_same: float, reference_frequency: float = 0.1, k: int = 50, dim: int = 256, seed: int = 7, best: int = 10, embedder: Embedder | None = None) -> dict[str, dict]:
    """Trains on one part of the entities and judges on another: per pair class recall among the k
    nearest by text, precision at ``best``, PR-AUC, prior and counts; the model under 'model'."""
    made = linker.context(cases, spec, alpha_same, reference_frequency, embedder or HashingTfidf(dim), k, seed)
    table = settle(linker.candidates(made))
    weights = linker.train(made, table)
    out = {}
    for r in linker.evaluate(made, weights, table, k, best).collect():
        cls = r["pair_class"]
        prior = made.priors.where(F.col("pair_class") == cls).orderBy(F.desc("true_pairs"), "key").first()
        out[cls] = {"recall": r["recall"] or None, "precision": r["precision"] or None, "pr_auc": r["pr_auc"] or None, "prior": prior["prior"] if prior else None, "true_pairs": r["true_pairs"] or 0, "candidates": r["candidates"] or 0, "model": weights[cls]}
    return out


# Verdicts


def verdicts(cases: DataFrame, world: G.World, fields: list[str], dropout: dict[str, dict[str, float]], confusion: dict[str, float], confusable: dict[str, list[tuple[str, str]]], absent: dict[str, list[str]] | None = None, times: int = 50, seed: int = 1, z_most: float = Z_MOST, dispersed: float = DISPERSED) -> dict[str, dict]:
    """Six verdicts on a recorded corpus (``generate.recorded``), each a dict with 'passed':
    background values as the world has them, correlation in the truth, correlation left after recording, no leak
    through metadata, series longer-tailed than chance, recording at its rates."""
    cases = settle(cases)
    out = {"background": _background(cases, world, z_most)}
    told = correlation(cases, fields, times, seed)
    out["truth"] = {"passed": told["true_passed"], "excess": told["true_excess"]}
    out["recorded"] = {"passed": told["recorded_passed"], "excess": told["recorded_excess"], "kept": told["kept"]}
    out["leaks"] = leakage(T.feed_positions(cases, ["state_code"], ["registered_at", "case_id"]), seed=seed)
    spread = T.dispersion(cases.where("is_serial"), "entity").first()
    out["tail"] = {"passed": (spread["index"] or 0) > dispersed, "index": spread["index"], "top_tenth_share": spread["top_tenth_share"]}
    out["recording"] = _recording(cases, fields, dropout, confusion, confusable, absent or {}, z_most)
    return out


def _background(cases: DataFrame, world: G.World, z_most: float) -> dict:
    """z-scores of every class's share and every value's share in background cases."""
    spark, one = cases.sparkSession, cases.where("not is_serial")
    tables = [T.realised(one.withColumn("all", F.lit("all")), "all", "crime_type", spark.createDataFrame([("all", v, float(p)) for v, p in zip(world.classes.values, world.classes.chance)], "cls string, value string, p double"))]
    copied = set(world.copies)
    for name in world.columns:
        rows = [(cls, v, float(p)) for cls, models in world.fields.items() if name in models for v, p in zip(models[name].values, models[name].chance)]
        if name in copied or not rows:
            continue
        expected = spark.createDataFrame(rows, "cls string, value string, p double")
        if any(models[name].tags for models in world.fields.values() if name in models):
            total = one.where(F.col(name).isNotNull()).groupBy(F.col("crime_type").alias("cls")).agg(F.count("*").alias("total"))
            n = one.select(F.col("crime_type").alias("cls"), F.explode(F.split(name, ";")).alias("value")).groupBy("cls", "value").agg(F.count("*").alias("n"))
            found = expected.join(total, "cls").join(n, ["cls", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            tables.append(found.select("cls", "value", "n", T.z_score(F.col("n") / F.col("total"), F.col("p"), F.col("total")).alias("z")))
        else:
            tables.append(T.realised(one, "crime_type", name, expected))
    long = None
    for t in tables:
        part = t.select("cls", "value", "z")
        long = part if long is None else long.union(part)
    row = long.agg(F.count("*").alias("checks"), F.max("z").alias("worst")).first()
    return {"passed": row["worst"] is not None and row["worst"] <= z_most, "checks": row["checks"], "worst_z": row["worst"]}


def _recording(cases: DataFrame, fields: list[str], dropout: dict, confusion: dict, confusable: dict, absent: dict, z_most: float) -> dict:
    """Blanks at their rates within z, confusions not above theirs, absent fields always blank."""
    facts = []
    for name in fields:
        if name not in cases.columns:
            continue
        near = list(G.neighbours_of(confusable.get(name, [])))
        plain = name != DERIVED  # a time band is that of the recorded window
        facts.append(F.struct(F.lit(name).alias("field"), F.col(name).alias("was"), F.col(f"rec_{name}").alias("said"), (F.col(name).isin(near) & F.lit(plain) if near else F.lit(False)).alias("mixable")))
    long = cases.select(F.col("state_code").alias("place"), F.explode(F.array(*facts)).alias("x")).select("place", "x.*").where("was is not null")
    rows = long.groupBy("place", "field").agg(F.count("*").alias("n"), F.count_if(F.col("said").isNull()).alias("blank"), F.count_if(F.col("mixable") & F.col("said").isNotNull()).alias("mixable"), F.count_if(F.col("mixable") & (F.col("said") != F.col("was"))).alias("mixed")).collect()  # places x fields
    failures, checks = [], 0
    for r in rows:
        place, name = r["place"], r["field"]
        if name in absent.get(place, ()):
            checks += 1
            if r["blank"] < r["n"]:
                failures.append(f"{place}.{name}: absent, but recorded")
            continue
        want = dropout.get(place, {}).get(name, dropout.get(place, {}).get("default", 0.0))
        if r["n"] >= LEAST_ROWS and name != DERIVED:
            checks += 1
            spread = (want * (1 - want) / r["n"]) ** 0.5
            gap = abs(r["blank"] / r["n"] - want)
            if gap > (z_most * spread if spread else 0.0):
                failures.append(f"{place}.{name}: {r['blank']} of {r['n']} blank, expected {want:.3f}")
        wrong = confusion.get(place, 0.0)
        if r["mixable"] >= LEAST_ROWS and 0 < wrong < 1:
            checks += 1
            if r["mixed"] / r["mixable"] - wrong > z_most * (wrong * (1 - wrong) / r["mixable"]) ** 0.5:
                failures.append(f"{place}.{name}: {r['mixed']} of {r['mixable']} confused, at most {wrong:.3f} expected")
    return {"passed": not failures, "checks": checks, "failures": failures}


def consistency_sweep(spark: SparkSession, world: G.World, record: Record, spec: LinkageSpec, offenders: int, background: int, rates: tuple[float, ...] = RATES, k: int = 50, dim: int = 256, seed: int = 7) -> list[dict]:
    """(repeat_rate, pr_auc and recall per pair class, prior): a corpus generated, linked, trained and
    judged at each rate; counts of entities stay the same, so priors hardly move."""
    out = []
    for rate in rates:
        here = replace(world, repeat_rate=rate)
        cases = as_cases(record(G.truth(spark, here, offenders, background, seed), here, seed), spec)
        found = experiment(cases, spec, here.alpha, here.reference_frequency, k, dim, seed)
        out.append({"repeat_rate": rate} | {f"{what}_{cls}": found[cls][what] for cls in found for what in ("pr_auc", "recall")} | {"prior_bits": found[SAME_TYPE]["prior"]})
    return out
