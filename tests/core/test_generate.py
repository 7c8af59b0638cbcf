"""The generator: same table for every partitioning, right distributions, recording and text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fslink.operators import generate as G

BAND = G.ValueModel(("night", "day"), (0.7, 0.3), ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0)))
TOOLS = G.ValueModel(("crowbar", "cutter", "vehicle"), (0.3, 0.1, 1.0), ((-1.0, 0, 0), (0, 0.5, 0), (2.0, 0, 0)), True)
WORLD = G.World(G.ValueModel(("HOME", "CAR"), (0.6, 0.4), ((0, 0, 0), (0, 0.5, 0))), {"HOME": {"band": BAND, "tools": TOOLS}, "CAR": {"band": BAND}}, {"A": ("Alpha", "Beta"), "B": ("Gamma",)}, {"A": 0.7, "B": 0.3}, {"A": ("B",), "B": ("A",)})


def test_tilts():
    neutral = np.zeros(3)
    assert BAND.tilted(neutral, 1) == pytest.approx([0.7, 0.3]) and TOOLS.tilted(neutral, 1) == pytest.approx([0.3, 0.1, 1.0])
    tilted = BAND.tilted(np.array([1.0, 0, 0]), 1)
    assert tilted[0] / tilted[1] == pytest.approx(0.7 / 0.3 * np.e) and TOOLS.tilted(np.array([1.0, 0, 0]), 1)[2] == 1.0
    assert G.expected_drift(BAND, 0.0) == pytest.approx([0, 0])


def test_truth(spark):
    cases = G.truth(spark, WORLD, 60, 300).cache()
    again = G.truth(spark, WORLD, 60, 300).repartition(2)
    key = lambda df: sorted(map(str, df.select("case_id", "entity", "series_index", "band", "tools", "fir_no", "occurred_from").collect()))
    assert key(cases) == key(again)
    one = cases.where("not is_serial")
    assert one.count() == 300 and abs(one.where("band = 'night'").count() / 300 - 0.7) < 0.12
    assert cases.select("case_id").distinct().count() == cases.count()
    assert cases.where("crime_type = 'CAR' and tools is not null").count() == 0 and cases.where("occurred_to < occurred_from or registered_at < occurred_to").count() == 0


def test_recording(spark):
    cases = G.truth(spark, WORLD, 10, 400)
    made = G.recorded(cases, ["band", "tools"], {"A": {"default": 0.5}, "B": {}}, {"A": 0.0, "B": 1.0}, {"band": [("night", "day")]}, {"B": ["tools"]})
    a, b = made.where("state_code = 'A'"), made.where("state_code = 'B'")
    assert abs(a.where("rec_band is null").count() / a.count() - 0.5) < 0.12 and a.where("rec_band <> band").count() == 0
    assert b.where("rec_band = band").count() == 0 and b.where("rec_tools is not null").count() == 0
    told = made.select(G.narrative(["rec_band"], {"rec_band": {"night": "struck at night", "day": "struck by day"}}, 1.0).alias("t"))
    assert {r.t for r in told.distinct().collect()} <= {"The accused struck at night.", "The accused struck by day.", "Details are not known."}
    assert told.where(F.col("t").contains("struck")).count() == made.where("rec_band is not null").count()
