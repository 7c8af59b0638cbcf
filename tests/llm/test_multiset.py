"""Fingerprints against plain Python, likeness against the true overlap, ranges of tied ids."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fslink.llm import multiset_hash as M

DATA = "/root/testdata/sf0.01"


def parts(text):
    return re.split(r"\n|(?<=[.!?]) ", text)


def vector(text):
    """Number of paragraphs, the 8 sums of words, the 128 sums of lanes (words 0 to 3, low bit first)."""
    wide, lanes = [0] * 8, [0] * 128
    for u in parts(text):
        d = hashlib.sha256(u.encode()).digest()
        words = [int.from_bytes(d[4 * k : 4 * k + 4]) for k in range(8)]
        wide = [a + b for a, b in zip(wide, words)]
        lanes = [a + (words[k // 32] >> k % 32 & 1) for k, a in enumerate(lanes)]
    return len(parts(text)), wide, lanes


def plain_fingerprint(text):
    n, wide, lanes = vector(text)
    pairs = [lanes[64 * h + s] % 65536 << 16 | lanes[64 * h + 32 + s] % 65536 for h in (0, 1) for s in range(32)]
    return "".join(f"{x:08X}" for x in [n, *(w % 2**32 for w in wide), *pairs])


def published(fingerprint):
    """The sums of signs, from the published text alone."""
    n, lanes = int(fingerprint[:8], 16), fingerprint[72:]
    residues = [int(lanes[4 * k : 4 * k + 4], 16) for k in range(128)]
    return [(2 * c - n + 65536) % 131072 - 65536 for c in residues]


def plain_likeness(a, b):
    x, y = published(a), published(b)
    both = sum(v * v for v in x) + sum(v * v for v in y)
    return 1.0 if x == y else 0.0 if not both else max(0.0, min(1.0, 2 * sum(p * q for p, q in zip(x, y)) / both))


def plain_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, e, n = map(plain_fingerprint, (text, edited, after))
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, plain_likeness(f, e), plain_likeness(f, n))
    return out


@pytest.mark.parametrize("ranges, step", [(1, 64), (40, 3)])
def test_edits_equal_plain_python(spark, monkeypatch, ranges, step):
    monkeypatch.setattr(M, "RANGES", ranges)
    monkeypatch.setattr(M, "RANGE_SAMPLE", 2)
    monkeypatch.setattr(M, "STEP", step)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(250)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, "É. ü! 😀? end\n\n"), (-5, ""), (None, "no id")], "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit("x") for c in ("next", "at", "guest", "key", "own", "placed", "tn", "tv", "t_made")})
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in M.edits(docs).collect()}
    assert got == plain_edits(rows)


def test_likeness_estimates_the_true_overlap(spark):
    rng = random.Random(2)
    pairs, truth = [], []
    for k in range(150):
        n = rng.randint(20, 60)
        shared = rng.randint(0, n)
        a = [f"paragraph {rng.random()}" for _ in range(n)]
        b = a[:shared] + [f"another {rng.random()}" for _ in range(n - shared)]
        rng.shuffle(b)
        pairs.append((k, "\n".join(a), "\n".join(b)))
        both = sum((Counter(a) & Counter(b)).values())
        truth.append(2 * both / (len(a) + len(b)))
    rows = spark.createDataFrame(pairs, "k long, a string, b string")
    for c in "ab":
        rows = M.with_vector(rows, c, c)
    got = rows.select("k", M.likeness(M.signs(F.col("an"), F.col("av")), M.signs(F.col("bn"), F.col("bv"))).alias("x")).orderBy("k").collect()
    errors = [r.x - t for r, t in zip(got, truth)]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1 and max(map(abs, errors)) < 0.35
    assert abs(sum(errors) / len(errors)) < 0.04


def test_ties_are_split_and_every_row_has_its_next(spark, monkeypatch):
    """Half of the rows have no id, a quarter one id; the order by id and hash is kept in every partitioning."""
    monkeypatch.setattr(M, "RANGE_SAMPLE", 3)
    rows = [(None if k % 2 else 7 if k % 4 else k, f"text {k}. of " + "words " * (k % 9)) for k in range(600)] + [(7, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    starts = M.range_starts(docs)
    assert len({s for s in starts if s[0] == 1}) >= 4 and len({s for s in starts if s[1] == ~7}) >= 2
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = Counter((a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    for n in (1, 6):
        got = M.with_next(docs.repartition(n), ["text"]).collect()
        assert Counter((r.text, r.next.text) for r in got) == want


def test_edge_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.edits(none).count() == 0 and M.fingerprints(none).count() == 0
    one = M.edits(spark.createDataFrame([(3, "a. b")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.n_chars == 4
    text = "\n".join(f"line {k}" for k in range(100_000))
    got = M.fingerprints(spark.createDataFrame([(1, text), (2, "\n".join(text.split("\n")[::-1]))], "doc_id long, text string")).collect()
    assert got[0].fingerprint == got[1].fingerprint == plain_fingerprint(text) and got[0].n_paragraphs == 100_000
