"""The secret scan's battery, cut, spans and redaction against plain Python; columns of clashing
names; long texts."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fslink.llm import secret_scan as S

CANDIDATE = re.compile(S.CANDIDATE, re.A)
BASE = [re.compile(S.ASSIGN), re.compile(S.ACCESS), re.compile(S.HEX)]


def tail(z):
    z = max(-12.0, min(12.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def plain_p(token):
    letters = next(a for p, a in S.ENCODINGS if re.search(p, token))
    t = token.rstrip("=")
    n, m = len(t), len(letters)
    if n < S.LEAST / 2:
        return 0.0
    chi, free = m / n * sum(t.count(c) ** 2 for c in set(t)) - n, m - 1
    z_chi = ((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    x = [letters.find(c) for c in t]
    turns = sum((a >= m / 2) != (b >= m / 2) for a, b in zip(x, x[1:]))
    z_runs = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    z_serial = sum((a - (m - 1) / 2) * (b - (m - 1) / 2) for a, b in zip(x, x[1:])) / ((m * m - 1) / 12 * math.sqrt(n - 1))
    ps = [tail(z_chi), min(1, 2 * tail(abs(z_runs))), min(1, 2 * tail(abs(z_serial)))]
    half = -sum(math.log(max(p, 1e-30)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def plain_spans(text, cut):
    base = [(m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text) if k or len(m[2]) >= 6]
    runs = [(m.start(), 3, m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    free = [r for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base)]
    kept = [r[:3] for r in free if plain_p(r[3]) / min(1.0, len(r[3]) / cut.mean_length) > cut.limit]
    return sorted(base), sorted(base + kept)


def made(n, seed=3):
    """Texts of random keys, structured runs, base secrets within them, and prose."""
    rng = random.Random(seed)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = [
        lambda: "".join(rng.choices(b64, k=rng.randint(18, 90))),
        lambda: "".join(rng.choices(b64[:52], k=rng.randint(18, 60))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 70))),
        lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=rng.randint(20, 40))) + "==",
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(10, 30))),
        lambda: "password" + rng.choice(["=", ": ", ' : "', "_"]) + "".join(rng.choices(b64[:62] + "._", k=rng.randint(3, 50))),
        lambda: f"chapter-{rng.randint(1, 99)}-of-the-book-aaaa-aaaa-{rng.randint(1, 9)}",
        lambda: "InternationalSupportLibraryFactory" * rng.randint(1, 2),
        lambda: "é😀 ordinary prose, with accents ñ and nothing else",
        lambda: "secret=" + "".join(rng.choices("0123456789abcdef", k=30)) + "-" + "".join(rng.choices(b64, k=30)),
    ]
    return ["".join(rng.choice(some)() + rng.choice([" ", "\n", ", ", "😀"]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_p_values(spark):
    tokens = sorted({t for text in made(30) for t in CANDIDATE.findall(text)} | {"a1" * 10, "=" * 20 + "a1", "A" * 30 + "bbbb1"})
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", S.p_value(F.col("t")).alias("p")).collect()
    assert len(got) > 300
    for r in got:
        assert r.p == pytest.approx(plain_p(r.t), rel=1e-6, abs=1e-12)


def test_the_cut_bounds_what_is_let_go(spark):
    texts = made(60)
    cut = S.structured_cut(spark.createDataFrame([(t,) for t in texts], "text string"))
    tokens = [t for text in texts for t in CANDIDATE.findall(text)]
    mean = sum(map(len, tokens)) / len(tokens)
    assert cut.mean_length == pytest.approx(mean)
    weighted = sorted(plain_p(t) / min(1.0, len(t) / mean) for t in tokens)
    exact = max((p for k, p in enumerate(weighted) if p <= S.RATE * (k + 1) / len(weighted)), default=0.0)
    # The histogram's cells are a twentieth of a decade and eight characters wide, and err on the side of reporting.
    assert exact / 3 <= cut.limit <= exact * 1.5


def test_spans_and_redaction_equal_plain_python(spark):
    texts = [*made(80), "", None, *made(3)[:2] * 2]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    # Names that the operator uses.
    docs = docs.withColumns({c: F.lit("x") for c in ("doc", "base_spans", "all_spans", "found", "base", "all", "run", "clean", "some", "s", "k", "e", "v")})
    cut = S.structured_cut(docs)
    rows = S.spans(docs, cut).collect()
    assert len(rows) == len(texts)
    clean = {r.doc_id: r for r in S.redacted(docs).collect()}
    assert S.redacted(docs).columns == docs.columns
    for r in rows:
        text = r.doc.text or ""
        base, every = plain_spans(text, cut)
        assert [tuple(x) for x in r.base_spans] == base and [tuple(x) for x in r.all_spans] == every
        out, at = [], 0
        for s, _, e in every:
            if s >= at:
                out += [text[at:s], S.REDACTED]
            at = max(at, e)
        want = "".join(out) + text[at:]
        own = clean[r.doc.doc_id]
        assert own.text == (None if r.doc.text is None else want) and own.n_chars == len(want)
    assert any(len(r.all_spans) > 2 * S.BLOCK for r in rows) or max(len(r.all_spans) for r in rows) > S.BLOCK


def test_long_texts_take_linear_time(spark):
    rng = random.Random(9)
    # More spans than two levels of blocks hold, and pieces longer than a chunk.
    words = ["".join(rng.choices("0123456789abcdef", k=26)) for _ in range(20_000)]
    text = " ".join(words) + " " + "plain words, " * 2000 + words[0]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = S.digest(docs).first()
    assert row.n_hex == len(words) + 1 and row.spans.startswith("hex:0:26,hex:27:53") and row.spans.endswith(f"hex:{len(text) - 26}:{len(text)}")
    want = " ".join([S.REDACTED] * len(words)) + " " + "plain words, " * 2000 + S.REDACTED
    assert S.redacted(docs).first().text == want
    assert time.time() - start < 60


def test_letters_alone_can_be_a_key(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(20)]
    dull = ["InternationalSupportLibraryFactoryBean", "thequickbrownfoxjumpsoverthelazydog", "ALLCAPITALSWITHOUTANYSPACEBETWEEN"] * 5
    rows = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(keys + dull)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_random) for r in S.digest(rows).collect())
    assert sum(n for k, n in got if k < len(keys)) >= 18 and sum(n for k, n in got if k >= len(keys)) == 0
