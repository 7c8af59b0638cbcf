"""Feeds of four layouts in small: one rule per test."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fslink.operators import normalise as N

VOCABULARY = N.Vocabulary(
    classes={"HOME": {"X": "HOUSE BREAKING", "Z": "HB"}, "CAR": {"X": "CAR THEFT", "Z": "MV"}},
    fields={
        "group": {"1": {"X": "ONE", "en": "acted alone"}, "2-3": {"X": "TWO", "en": "were two"}},
        "tools": {"crowbar": {"X": "CROWBAR", "en": "used a crowbar"}, "cutter": {"X": "CUTTER", "en": "used a cutter"}, "none_observed": {"X": "NIL", "en": "no sign of tools"}},
        "target": {"shop": {"en": "targeted a shop"}, "shop_home": {"en": "targeted a shop-cum-residence"}},
        "door": {"roof": {"X": "ROOF", "en": "through the roof"}},
        "engine": {"key": {"X": "KEY", "en": "with a key"}},
    },
    family_of={"HOME": "house", "CAR": "vehicle"},
    core=("time_band", "group", "tools", "target"),
    ext={"house": ("door",), "vehicle": ("engine",)},
    tags=frozenset({"tools"}),
)
X = N.Feed("X", {"fir_no": "NO", "crime_type": "HEAD", "occurred_from": "FROM", "occurred_to": "TO", "registered_at": "REG", "group": "GRP", "tools": "TOOLS", "door": "DOOR", "engine": "ENGINE", "narrative": "STORY"}, delimiter="|", absent=("target",))
Z = N.Feed("Z", {"fir_no": "no", "crime_type": "head", "occurred_from": "from", "occurred_to": "to", "registered_at": "reg", "mo_description": "mo", "narrative": "story"}, N.FREE_TEXT, "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
BASE = {"NO": "7/2021", "HEAD": "HOUSE BREAKING", "FROM": "01/02/2021 22:30", "TO": "02/02/2021 00:00", "REG": "03/02/2021 10:00", "GRP": "ONE", "TOOLS": "CROWBAR|CUTTER", "DOOR": "ROOF", "ENGINE": "", "STORY": "text"}


def run(spark, feed=X, strict=True, extract=False, **change):
    row = change.pop("row", BASE) | change
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return N.normalise(rows, feed, VOCABULARY, extract, strict).collect()


def test_full_row(spark):
    r = run(spark)[0]
    assert (r.crime_type, r.family, r.group, r.tools, r.door, r.engine, r.time_band) == ("HOME", "house", "1", ["crowbar", "cutter"], "roof", None, "night")
    assert r.occurred_from == datetime(2021, 2, 1, 22, 30) and r.target is None and r.target__status == N.ABSENT and r.engine__status is None
    assert r.field_provenance == {"time_band": "source", "group": "source", "tools": "source", "target": None, "door": "source"}
    import hashlib

    assert r.case_id == hashlib.sha1(b"X7/20212021").hexdigest()[:16]


def test_out_of_scope_and_blanks(spark):
    assert run(spark, HEAD="FRAUD") == []
    r = run(spark, GRP="", TOOLS="")[0]
    assert r.group is None and r.group__status == N.MISSING and r.tools is None and r.tools__status == N.MISSING and r.field_provenance["group"] is None
    r = run(spark, TOOLS="NIL")[0]
    assert r.tools == [] and r.tools__status is None


def test_unknown_labels(spark):
    with pytest.raises(Exception, match="unknown label"):
        run(spark, GRP="FIVE")
    assert run(spark, strict=False, GRP="FIVE")[0].group is None


def test_windows(spark):
    assert run(spark, TO="03/02/2021 12:31")[0].time_band__status == N.UNKNOWABLE
    assert run(spark, FROM="01/02/2021 22:30", TO="02/02/2021 10:30")[0].time_band == "early_morning"  # exactly 12 hours, middle 4:30
    r = run(spark, FROM="01/02/2021", TO="01/02/2021")[0]
    assert r.time_band__status == N.MISSING and r.occurred_from == datetime(2021, 2, 1)
    for a, b, band in (("22:30", "23:59", "night"), ("05:00", "05:30", "early_morning"), ("12:00", "12:30", "day")):
        assert run(spark, FROM=f"01/02/2021 {a}", TO=f"01/02/2021 {b}")[0].time_band == band


def test_free_text(spark):
    row = {"no": "9", "head": "HB", "from": "2021-02-01T12:00:00", "to": "2021-02-01T12:30:00", "reg": "2021-02-02T08:00:00", "mo": "Accused USED A CROWBAR; acted alone; targeted a shop-cum-residence.", "story": "x"}
    r = run(spark, Z, row=row)[0]
    assert r.tools is None and r.tools__status == N.MISSING and r.needs_enrichment
    r = run(spark, Z, extract=True, row=row)[0]
    assert (r.tools, r.group, r.target, r.door) == (["crowbar"], "1", "shop", None)  # the first match in vocabulary order
    assert r.field_provenance["tools"] == "llm_extracted" and r.door__status == N.MISSING
    assert run(spark, Z, extract=True, row=row | {"mo": "", "story": "no sign of tools"})[0].tools == []


def test_validation_and_patterns(spark):
    rows = spark.createDataFrame([('{"tools": ["crowbar"], "group": "1"}',), ('{"tools": ["crowbar", "bomb"], "group": "9"}',), ("not json",)], "r string")
    got = [(r.t, r.g) for r in rows.select(N.validated(F.col("r"), "tools", VOCABULARY).alias("t"), N.validated(F.col("r"), "group", VOCABULARY).alias("g")).collect()]
    assert got == [(["crowbar"], "1"), (None, None), (None, None)]
    assert N.spark_pattern("%d-%b-%Y %H%M hrs") == "dd-MMM-yyyy HHmm 'hrs'" and N.spark_pattern("%d-%m-%Y %I:%M %p") == "dd-MM-yyyy hh:mm a"


def test_agreement_and_record(spark):
    rows = spark.createDataFrame([tuple(BASE.values())], ", ".join(f"{k} string" for k in BASE))
    cases = N.normalise(rows, X, VOCABULARY)
    truth = cases.select("case_id", F.lit("1").alias("group"), F.lit("wall").alias("door"))
    got = {r.field: (r.n, r.agreed, r.passed) for r in N.agreement(cases, truth, ["group", "door"]).collect()}
    assert got == {"group": (1, 1.0, True), "door": (1, 0.0, False)}
    record = N.nested(cases, VOCABULARY).first()
    assert record.mo_core.target == N.ABSENT and record.mo_ext_house.door == "roof" and record.mo_ext_vehicle is None
