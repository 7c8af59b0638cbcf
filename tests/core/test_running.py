"""Running sums by range: one key with most of the rows, nulls, ties broken by the caller."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from fslink.operators import generate as G
from fslink.operators import metrics
from fslink.operators import statistics as T
from tests.core.test_generate import WORLD
from tests.core.test_studies import EDGES, NAMES, record
from tests.core.test_studies import WORLD as STUDY


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(k, None if k % 11 == 0 else "hot" if k % 5 else f"c{k % 3}", rng.randrange(9)) for k in range(2000)]
    got = T.running(spark.createDataFrame(rows, "id long, key string, n long"), ["key"], [F.desc("n"), F.asc("id")], {"total": F.col("n"), "place": F.lit(1)})
    want = {}
    order = lambda r: (r[1] or "", -r[2], r[0])
    for _, part in groupby(sorted(rows, key=order), key=lambda r: r[1] or ""):
        total, part = 0, list(part)
        for place, r in enumerate(part, 1):
            total += r[2]
            want[r[0]] = (total, place, sum(x[2] for x in part), len(part))
    assert {r.id: (r.total, r.place, r.total_all, r.place_all) for r in got.collect()} == want


def test_pr_auc_equals_its_definition(spark):
    rng = random.Random(6)
    rows = [(k, k + 1, c, int(rng.random() < 0.3), round(rng.random(), 2)) for k in range(900) for c in ("same_type", "cross_type")]
    got = {r.pair_class: r for r in metrics.pr_auc(spark.createDataFrame(rows, "id_a long, id_b long, pair_class string, label int, score double")).collect()}
    for cls, found in got.items():
        mine = [r for r in rows if r[2] == cls]
        positives, area, recall, precision = sum(r[3] for r in mine), 0.0, 0.0, 1.0
        for s in sorted({r[4] for r in mine}, reverse=True):
            best = [r for r in mine if r[4] >= s]
            p, q = sum(r[3] for r in best) / len(best), sum(r[3] for r in best) / positives
            area, recall, precision = area + (q - recall) * (p + precision) / 2, q, p
        assert abs(found.pr_auc - area) < 1e-9 and (found.positives, found.pairs) == (positives, len(mine))


def test_series_fit_the_span_and_the_corpus_its_share(spark):
    for k in range(200):
        made = G.series(WORLD, 7, k)
        assert len(made) >= 2 and [x["series_index"] for x in made] == list(range(len(made)))
    short = G.fitted(__import__("numpy").array([0.0, 5000.0, 9000.0]), 100.0, 0.5)
    assert len(short) == 3 and short[-1] <= 100
    cases = G.corpus(spark, WORLD, 500, 0.3)
    serial = cases.where("is_serial").count()
    assert cases.count() == 500 and 150 <= serial < 150 + 60
    assert cases.where("is_serial").groupBy("entity").count().where("count < 2").count() == 0
    assert G.offenders_for(spark, WORLD, 0) == (0, 0)


def test_six_verdicts(spark):
    from fslink.operators import studies as Y

    rates = {"X": {"default": 0.1}, "Z": {"default": 0.1}}
    cases = record(G.truth(spark, STUDY, 250, 900, 3), STUDY, 3)
    found = Y.verdicts(cases, STUDY, NAMES, rates, {"X": 0.05, "Z": 0.05}, EDGES, times=5)
    assert list(found) == ["background", "truth", "recorded", "leaks", "tail", "recording"] and all("passed" in v for v in found.values())
    assert found["background"]["passed"] and found["background"]["checks"] > 10 and found["recording"]["passed"], found
    wrong = Y._recording(cases, NAMES, {"X": {"default": 0.4}, "Z": {"default": 0.1}}, {"X": 0.001, "Z": 0.05}, EDGES, {"Z": ["group"]}, 4.0)
    assert not wrong["passed"] and any(f.startswith("Z.group: absent") for f in wrong["failures"]) and any(f.startswith("X.") for f in wrong["failures"])


def test_shuffles_match_their_definition_slice_by_slice(spark, monkeypatch):
    import hashlib
    from collections import Counter

    import numpy as np

    from fslink.operators import statistics as T

    rng = np.random.default_rng(3)
    rows = [(int(i), "a" if i % 5 else None, str(rng.integers(0, 3)) if i % 11 else None, str(rng.integers(0, 4)) if i % 7 else None) for i in rng.permutation(600)]
    df = spark.createDataFrame(rows, "id long, cls string, x string, y string")
    monkeypatch.setattr(T, "SLICE_ROWS", 50)
    monkeypatch.setattr(T, "NULL_ROWS", 1300)
    joined = []
    monkeypatch.setattr(type(df), "hint", lambda self, *a: joined.append(a) or self)
    got = {(r.replicate, r.cls): (r.n, round(r.mi_bits, 9)) for r in T.permutation_null(df, "id", "cls", "x", "y", 5).collect()}
    want = {}
    for rep in range(1, 6):
        for cls in ("a", None):
            own = [r for r in rows if r[1] == cls and r[2] is not None and r[3] is not None]
            xs = [r[2] for r in sorted(own)] if cls else [r[2] for r in sorted(own, key=lambda r: r[0])]
            ys = [r[3] for r in sorted(own, key=lambda r: hashlib.md5(f"1:{rep}:{r[0]}".encode()).hexdigest())]
            cells, nx, ny, n = Counter(zip(xs, ys)), Counter(xs), Counter(ys), len(own)
            want[rep, cls] = (n, round(sum(c / n * np.log2(c * n / (nx[x] * ny[y])) for (x, y), c in cells.items()), 9))
    assert got == want and not joined


def test_summed_shuffles_share_one_sort_and_equal_those_of_each_pair(spark):
    from fslink.operators import statistics as T
    from fslink.operators import studies

    rows = [(i, "ab"[i % 2], str(i * 7 % 3), str(i * 5 % 4) if i % 6 else None, str(i % 5)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, cls string, x string, y string, z string")
    each = {}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        for r in T.permutation_null(df, "id", "cls", a, b, 3).collect():
            each[r.replicate] = each.get(r.replicate, 0) + r.mi_bits
    row = studies.excess_information(df, "id", "cls", ["x", "y", "z"], 3).first()
    assert abs(row.null_mean - sum(each.values()) / 3) < 1e-9 and abs(row.null_max - max(each.values())) < 1e-9


def test_hashes_of_many_messages_equal_those_of_each():
    import hashlib

    import pyarrow as pa

    from fslink.operators import statistics as T

    tails = [f":{k * 7919 ** (k % 4)}" for k in range(20_000)] + ["", ":ä"]
    for some, begin in ((tails, "1:50"), (tails, "12345:7"), ([*tails, ":" + "x" * 40], "1:2"), ([*tails[:9], ":" + "x" * 53], "1:2"), ([*tails[:9], ":" + "y" * 200], "1:2")):
        got = T._Tails(pa.chunked_array([some[:5], some[5:]])).md5(begin.encode())
        assert [bytes(x).hex() for x in got] == [hashlib.md5((begin + t).encode()).hexdigest() for t in some]


def test_replicates_are_shuffled_as_bytes_and_observed_sums_as_counts(spark):
    """Of a row and replicate only its MD5 and a byte a field is shuffled, and no row is multiplied by pairs."""
    from fslink.operators import statistics as T
    from fslink.operators import studies

    n = 20_000
    df = spark.range(n).selectExpr("id", "if(id % 3 = 0, null, concat('c', id % 2)) cls", "cast(id % 3 as string) x", "if(id % 7 = 0, null, cast(id % 5 as string)) y", "cast(id % 11 as string) z")
    written = []
    kept = T._Kept.packed

    def packed(self, *a):
        run = kept(self, *a)
        size = spark.sparkContext.accumulator(0)
        written.append(size)

        def counted(batches):
            for b in run(batches):
                size.add(sum(len(h.as_py()) for h in b["held"]))
                yield b

        return counted

    T._Kept.packed = packed
    try:
        row = studies.excess_information(df, "id", "cls", ["x", "y", "z"], 4).first()
    finally:
        T._Kept.packed = kept
    assert sum(x.value for x in written) == n * 4 * 19 and isinstance(row.observed, float)
    each = sum(r.mi_bits for a, b in (("x", "y"), ("x", "z"), ("y", "z")) for r in T.mutual_information(df, "cls", a, b).collect())
    assert abs(row.observed - each) < 1e-9 and row.null_max >= row.null_mean > 0
