"""Mixing against plain Python: targets, ranks, places on the line, positions, order; ties, hot
sources, clashing names."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fslink.llm import mixing
from tests.llm.test_operators import ROWS, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, most=3):
    """Shares by weight; the excess above ``most`` times a size is shared anew until none is above."""
    found, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        heavy = sum(weights[i] for i in open_)
        for i in open_:
            found[i] = left * weights[i] / heavy
        over = {i for i in open_ if found[i] > most * sizes[i]}
        if not over:
            break
        for i in over:
            found[i] = float(most * sizes[i])
        left -= sum(found[i] for i in over)
        open_ -= over
    return found


def plain_position(share, rising):
    """The time by which so much is demanded, by bisection of the integral of 0.5+t or 1.5-t."""
    integral = (lambda t: 0.5 * t + t * t / 2) if rising else (lambda t: 1.5 * t - t * t / 2)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if integral(mid) < share else (low, mid)
    return (low + high) / 2


def plain_mix(rows):
    """(doc_id, source, size, source_size, target, taken, positions) of rows (doc_id, text, source, key, tie)."""
    by = defaultdict(list)
    for doc, text, source, key, tie in rows:
        by[source].append((key, doc is not None, doc, tie, len(WORD.findall(text or ""))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[4] for r in by[s]) for s in names]
    goals = plain_targets(sizes, [k % 3 + 1 for k in range(len(names))])
    out = []
    for rank, (source, whole, goal) in enumerate(zip(names, sizes, goals)):
        begin, passes = 0, int(goal // whole) if whole else 0
        rest = round(goal) - passes * whole
        for _, _, doc, _, size in sorted(by[source]):
            extra = min(max(rest - begin, 0), size)
            turns = (passes + (extra > 0)) if size else 0
            places = [plain_position(min(1.0, (p * whole + begin + size / 2) / goal), rank % 2 == 0) for p in range(turns)]
            out.append((doc, source, size, whole, goal, passes * size + extra, places))
            begin += size
    return out


def keyed(docs):
    """doc_id, text, source, and the hashes that order a source's documents."""
    few = docs.select("doc_id", "text", "source")
    return [tuple(r) for r in few.select("*", mixing.order_key(), F.xxhash64("doc_id", "text", "source", F.lit(mixing.TIE_SEED))).collect()]


def brief(rows):
    """Rows in an order of their own, floats rounded."""
    return sorted(((d is None, d or 0, s or "", z, w, round(t, 6), n, tuple(round(x, 6) for x in p)) for d, s, z, w, t, n, p in rows), key=str)


def many(spark, n):
    hosts = [(k, " ".join(f"w{j}" for j in range(k % 23)), "hot" if k % 3 else f"host{k % 40}" if k % 5 else None) for k in range(n)]
    return spark.createDataFrame(hosts, "doc_id long, text string, source string")


@pytest.mark.parametrize("rows_a_bucket, section_bits", [(2000, 11), (7, 2)])
def test_mix_equals_plain_python(spark, monkeypatch, rows_a_bucket, section_bits):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_a_bucket)
    monkeypatch.setattr(mixing, "SECTION_BITS", section_bits)
    for docs in (many(spark, 700), spark.createDataFrame(ROWS, SCHEMA)):
        got = mixing.mix(docs).collect()
        assert brief(got) == brief(plain_mix(keyed(docs)))
        first = [r.positions[0] for r in got if r.positions]
        assert first == sorted(first) and all(not r.positions for r in got[len(first) :])


def test_one_hot_key_of_ties(spark, monkeypatch):
    """All rows of one id, of different texts, and copies among them: any partitioning gives the same."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = [(None if k % 2 else 7, f"text {k % 37} of some words " * (1 + k % 4), "en", "a" if k % 7 else "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    results = [sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5)]
    assert results[0] == results[1]
    orders = [mixing.training_order(docs.repartition(n, "text")).collect() for n in (2, 6)]
    assert orders[0] == orders[1] and len(orders[0]) > 0
    # Different texts of one id are spread over buckets.
    keys = {r[0] for r in docs.select(mixing.order_key()).collect()}
    assert len(keys) >= 37


def test_training_order_is_whole_documents_near_the_targets(spark):
    docs = many(spark, 400).withColumns({c: F.lit("own " + c) for c in ("doc", "key", "tie", "size", "turn", "position", "bucket", "section", "words", "target", "knots", "rank", "part", "begin")})
    made = mixing.training_order(docs)
    assert made.columns == docs.columns
    rows = made.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] and r.tie == "own tie" for r in rows)
    mixed = {r.source: r for r in mixing.mix(docs).collect()}
    given, longest = Counter(), Counter()
    for r in rows:
        given[r.source] += len(WORD.findall(r.text))
        longest[r.source] = 22
    for source, r in mixed.items():
        assert abs(given[source] - r.target) <= longest[source] / 2 + 1
    assert max(Counter(r.doc_id for r in rows).values()) <= 3


def test_sources_by_the_thousand(spark):
    sources = [(f"h{k:05d}" if k else None, (k * 37) % 101, 1) for k in range(3000)]
    ranked = mixing.ranked(spark.createDataFrame(sources, "source string, size long, n long")).collect()
    assert [r.source for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(s for s, *_ in sources if s) + [None]
    weights = {r.source: r["rank"] % 3 + 1.0 for r in ranked}
    table = spark.createDataFrame([(s, z, weights[s]) for s, z, _ in sources], "source string, size long, weight double")
    level = mixing.water_level(table)
    want = plain_targets([z for _, z, _ in sources], [weights[s] for s, *_ in sources])
    assert [min(level * weights[s], 3.0 * z) for s, z, _ in sources] == pytest.approx(want)
    assert mixing.water_level(table.limit(0)) == 0 and mixing.water_level(table.where("size = 0")) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0 and mixing.training_order(none).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None), (2, " ", "en", "a")], SCHEMA)
    assert [(r.doc_id, r.taken) for r in sorted(mixing.mix(blank).collect(), key=lambda r: r.doc_id)] == [(1, 0), (2, 0)]
    assert mixing.training_order(blank).count() == 0
