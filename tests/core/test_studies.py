"""Rendering and back, the checker, and the studies over small corpora."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fslink.operators import check as C
from fslink.operators import generate as G
from fslink.operators import normalise as N
from fslink.operators import render as R
from fslink.operators import studies as Y
from fslink.operators.statistics import feed_positions
from fslink.spec import TAGS, FieldSpec, LinkageSpec

AXES = ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (-1.0, 0.5, 0.0))


def _value(*values, p=None):
    return G.ValueModel(values, p or tuple([1 / len(values)] * len(values)), AXES[: len(values)])


TOOLS = G.ValueModel(("crowbar", "cutter"), (0.4, 0.3), AXES[:2], True)
FIELDS = {"time_band": _value("night", "early_morning", "day", p=(0.5, 0.2, 0.3)), "group": _value("1", "2-3", "4+"), "exit": _value("foot", "car", "bus"), "tools": TOOLS}
WORLD = G.World(
    _value("HOME", "CAR", p=(0.6, 0.4)), {"HOME": FIELDS | {"door": _value("roof", "wall", "gate")}, "CAR": FIELDS}, {"X": ("Alpha", "Beta"), "Z": ("Gamma",)}, {"X": 0.6, "Z": 0.4}, {"X": ("Z",), "Z": ("X",)},
    bands={"night": (22, 4), "early_morning": (4, 7), "day": (7, 22)}, widths={"HOME": (1.0, 0.3)},
)
WORDS = {f: {v: {"X": f"{f} {v}".upper(), "en": f"had {f} of {v}"} for v in m.values} for f, m in WORLD.fields["HOME"].items()}
WORDS["tools"]["none_observed"] = {"X": "NIL", "en": "left no tools"}
VOCABULARY = N.Vocabulary({"HOME": {"X": "HB", "Z": "House", "en": "burglary"}, "CAR": {"X": "MV", "Z": "Car", "en": "car theft"}}, WORDS, {"HOME": "house", "CAR": "vehicle"}, ("time_band", "group", "exit", "tools"), {"house": ("door",)}, frozenset({"tools"}))
ID = {"fir_no": "NO", "district": "DIST", "crime_type": "HEAD", "occurred_from": "FROM", "occurred_to": "TO", "registered_at": "REG"}
X = N.Feed("X", ID | {"group": "GRP", "tools": "TOOLS", "door": "DOOR", "narrative": "STORY"}, delimiter="|", absent=("exit",))
Z = N.Feed("Z", ID | {"mo_description": "MO", "narrative": "STORY"}, N.FREE_TEXT, "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
EDGES = {"group": [("1", "2-3")], "tools": [("crowbar", "cutter")], "door": [("roof", "wall")], "crime_type": [("CAR", "ROBBERY")]}
NAMES = ["time_band", "group", "exit", "tools", "door"]


def record(cases, world, seed, wrong=0.05, drop=0.1):
    return G.recorded(cases, ["crime_type", *NAMES], {"X": {"default": drop}, "Z": {"default": drop}}, {"X": wrong, "Z": wrong}, EDGES, {}, seed, world, frozenset({"tools"}))


def test_clocks(spark):
    cases = G.truth(spark, WORLD, 20, 300).where("crime_type = 'HOME'")
    width = cases.select(F.expr("percentile_approx((unix_seconds(occurred_to) - unix_seconds(occurred_from)) / 3600.0, 0.5) AS m")).first().m
    assert 0.7 < float(width) < 1.3
    made = record(cases, WORLD, 7, 0.0, 0.0)
    share = made.where("rec_time_band is not null").agg(F.avg((F.col("rec_time_band") == F.col("time_band")).cast("double"))).first()[0]
    assert share > 0.85  # windows near a band's border may fall on its other side


def test_round_trip(spark):
    made = record(G.truth(spark, WORLD, 40, 300), WORLD, 7).cache()
    rows = R.native(made, X, VOCABULARY, 0.1, 0.1, ("It rained.", "Nobody saw it."))
    assert rows.columns == list(X.columns.values())
    back = N.normalise(rows, X, VOCABULARY).alias("n").join(made.where("state_code = 'X'").alias("t"), "case_id")
    assert back.count() == made.where("state_code = 'X' and rec_crime_type <> 'ROBBERY'").count() > 100
    tags = F.array_join(F.array_sort("n.tools"), ";")
    same = (F.col("n.group").eqNullSafe(F.col("rec_group"))) & tags.eqNullSafe(F.col("rec_tools")) & F.col("n.time_band").eqNullSafe(F.col("rec_time_band")) & F.col("n.crime_type").eqNullSafe(F.col("rec_crime_type"))
    assert back.where(~same).count() == 0 and back.where("n.tools is not null and size(n.tools) = 0").count() > 0
    assert back.where("n.crime_type = 'HOME' and not (n.door <=> rec_door)").count() == 0
    assert rows.where("STORY like '%had %'").count() > 100 and rows.where("STORY like '%rained.'").count() > 0
    free = N.normalise(R.native(made, Z, VOCABULARY), Z, VOCABULARY, extract=True).alias("n").join(made.where("state_code = 'Z'").alias("t"), "case_id")
    assert free.where(~F.col("n.exit").eqNullSafe(F.col("rec_exit")) | ~F.array_join(F.array_sort("n.tools"), ";").eqNullSafe(F.col("rec_tools"))).count() == 0


def test_listed(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "c array<string>")
    assert [r[0] for r in rows.select(R.listed(F.col("c"))).collect()] == ["", "a", "a and b", "a, b and c"]


def test_checker():
    assert C.check_all(WORLD, [X, Z], VOCABULARY, EDGES) == []
    bad = replace(WORLD, shares={"X": 0.6, "Z": 0.3}, neighbours={"X": ("Q",)}, bands={"night": (22, 5), "day": (4, 22)}, classes=_value("HOME", "CAR", p=(0.6, 0.6)), repeat_rate=0.05)
    assert {w for w, _ in C.check_world(bad, {"group": [("1", "9")]})} == {"shares", "neighbours.X", "bands", "classes", "repeat_rate", "confusable.group"}
    feed = replace(X, columns=X.columns | {"exit": "GRP"}, delimiter=" ", date_format="%d/%m/%Y %H", absent=("exit",))
    found = C.check_feed(feed, VOCABULARY)
    assert {w for w, _ in found} == {"feeds.X", "feeds.X.tools"} and sum("share a native name" in x or "loses part" in x or "is absent" in x for _, x in found) == 3
    assert any("no column" in x for _, x in C.check_feed(replace(X, columns={"fir_no": "NO"}), VOCABULARY))


def test_excess_information(spark):
    rows = [(i, "A", str(i % 3), str(i % 3), str((i * 7919 >> 4) % 2)) for i in range(300)]
    cases = spark.createDataFrame(rows, "id long, cls string, x string, y string, z string")
    r = Y.excess_information(cases, "id", "cls", ["x", "y"], 5).first()
    assert r.observed == pytest.approx(1.58496, abs=1e-4) and r.null_max < 0.1 and r.excess == pytest.approx(r.observed - r.null_mean)
    assert Y.excess_information(cases.limit(0), "id", "cls", ["x", "y", "z"], 3).first().asDict() == {"observed": 0.0, "null_mean": 0.0, "null_max": 0.0, "excess": 0.0}


def test_tau(spark):
    made = Y.select_tau(spark, WORLD, lambda c, w, s: record(c, w, s, 0.0, 0.0), ["group", "exit"], 500, (0.0, 2.0), (7,), 5)
    flat, strong = made["grid"]
    assert made["chosen"] == 2.0 and strong["seeds"][0]["kept"] == pytest.approx(1.0) and flat["expected_drift"] == pytest.approx(0.0)


def test_leakage(spark):
    cases = feed_positions(G.truth(spark, WORLD, 150, 100), ["state_code"], ["registered_at", "case_id"])
    r = Y.leakage(cases, 3)
    assert r["pairs"] > 500 and 0.6 < r["auc_time"] < 1 and r["passed"] == (r["added"] < 0.01)
    told = Y.leakage(cases.withColumn("position", F.pmod(F.xxhash64("entity"), F.lit(100000))).withColumn("total", F.lit(100000)), 3)
    assert told["added"] > 0.02 and not told["passed"]


def test_sweep(spark):
    spec = LinkageSpec(fields=(FieldSpec("group"), FieldSpec("exit"), FieldSpec("time_band"), FieldSpec("tools", TAGS)), text="text")
    low, high = Y.consistency_sweep(spark, WORLD, record, spec, 60, 40, (0.3, 0.9), 20, 64)
    assert (low["repeat_rate"], high["repeat_rate"]) == (0.3, 0.9) and high["pr_auc_same_type"] > low["pr_auc_same_type"]
    assert -12 < high["prior_bits"] < 0 and 0 < high["recall_same_type"] <= 1
