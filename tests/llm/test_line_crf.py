"""The line CRF: labels of mixed documents, the verdict from plain Python, and training against
enumeration."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fslink.llm import line_crf, line_crf_training
from fslink.llm.wordstats import measured

DATA = "/root/testdata/sf0.01"
SENTENCE = "The river rose, the town slept, and nobody saw the water come, not even the dog."
PROSE = [f"{SENTENCE} That was day {'abcdefghijklmnop'[k]}." for k in range(12)]
MENU = "Home | About | Contact | Login"


def labels(text):
    return [x for g in measured(pa.array([text], pa.string())) for x in line_crf.line_labels(g).tolist()]


@pytest.mark.parametrize(
    "lines, want",
    [
        (PROSE[:6] + ["BUY NOW!!! CHEAP!!! TODAY!!!", MENU] + PROSE[6:], [0] * 6 + [1, 1] + [0] * 6),
        ([MENU] * 3 + PROSE[:6], [1] * 3 + [0] * 6),
        (PROSE, [0] * 12),
        ([MENU, "a### b*** c$$$ d%%% e&&& f###", "Home", "Login"], [1] * 4),
    ],
)
def test_mixed_documents_get_mixed_labels(lines, want):
    assert labels("\n".join(lines)) == want


def plain_features(text):
    """The features of each line, from the text's characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, at, rows = text.split("\n"), set(), 0, []
    for k, line in enumerate(lines):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        chars = max(1, sum(map(len, own)))
        raw = (line + "\n" * (k + 1 < len(lines))).encode()
        count = lambda f, raw=raw: sum(map(f, raw))
        letters = max(1, count(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))
        n = max(1, len(own))
        same = sum(words[i] == words[i - 1] for i in range(max(1, at), at + len(own)))
        whole = len(line) + (k + 1 < len(lines))
        row = [1, min(1, 10 * count(lambda b: b in b"#*$%&|<>") / chars), count(lambda b: 65 <= b <= 90) / letters, count(lambda b: 48 <= b <= 57) / chars, min(1, count(lambda b: b == 33) / n), min(1, count(lambda b: b == 124) / n)]
        row += [sum(i in covered for i in range(at, at + len(own))) / n, same / n, line in seen and bool(own), len(own) < 3, not re.search("[.,]", line) and len(raw) < 2 * max(1, whole), min(1, len(own) / 20), len(lines) == 1]
        rows.append([min(1.0, float(x)) for x in row])
        seen.add(line)
        at += len(own)
    return rows


def plain_verdict(text):
    """kept and the content share, by enumeration of all labellings."""
    rows = plain_features(text)
    scores = [sum(a * b for a, b in zip(r, line_crf.WEIGHTS)) for r in rows]
    worth = lambda p: sum(s for s, x in zip(scores, p) if x) + sum(line_crf.TRANSITIONS[a][b] for a, b in zip(p, p[1:]))
    best = max(itertools.product((0, 1), repeat=len(rows)), key=worth)
    sizes = [sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x))) for x in text.split("\n")]
    share = sum(s for s, x in zip(sizes, best) if not x) / max(1, sum(sizes))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) >= 20 and 100 * len(covered) <= 30 * len(words) and share >= line_crf.MIN_SHARE, share


def test_verdicts_equal_enumeration(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = {r.doc_id: r.text or "" for r in docs.collect() if (r.text or "").count("\n") < 9 and len(r.text or "") < 6000}
    rows = [(k, t) for k, t in sorted(short.items())[:150]]
    rows += [(10**6 + k, line_crf_training.planted(t, k)[0]) for k, t in rows[:100]]
    rows = [(k, t) for k, t in rows if t.count("\n") < 12] + [(10**7, ""), (10**7 + 1, None), (10**7 + 2, "日本語の文章です\n" * 3)]
    got = {r.doc_id: r for r in line_crf.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        kept, share = plain_verdict(text or "")
        assert (got[k].kept, pytest.approx(got[k].content_share)) == (kept, share)
    assert len({round(r.content_share, 2) for r in got.values()}) > 20


def test_fit_reaches_the_greatest_likelihood():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 6, 40)
    features = rng.random((int(lengths.sum()), 3))
    features[:, 0] = 1
    truth = (features[:, 1] + rng.normal(0, 0.5, len(features)) > 0.5).astype(int)
    shrink = 1e-2
    weights, steps = line_crf.fit(features, lengths, truth, rounds=1500, shrink=shrink)

    def likelihood(w, s):
        total, at = 0.0, 0
        for n in lengths:
            score, own = features[at : at + n] @ w, truth[at : at + n]
            worth = lambda p, score=score: sum(a for a, x in zip(score, p) if x) + sum(s[a][b] for a, b in zip(p, p[1:]))
            total += worth(own) - math.log(sum(math.exp(worth(p)) for p in itertools.product((0, 1), repeat=int(n))))
            at += n
        return total / len(truth) - shrink * ((w**2).sum() + (s**2).sum()) / 2

    best = likelihood(weights, steps)
    for _ in range(60):
        assert likelihood(weights + rng.normal(0, 0.05, 3), steps + rng.normal(0, 0.05, (2, 2))) <= best + 1e-9


def test_held_out_line_accuracy(spark):
    docs, marks = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    lines, mixed = line_crf_training.accuracy(line_crf_training.good_documents(docs, marks, True), seed=77)
    assert lines > 0.97 and mixed > 0.95


def test_training_gives_a_labeller(spark):
    docs, marks = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    weights, steps = line_crf_training.train(docs, marks, sample=150)
    for text, want in (("\n".join(PROSE[:5] + [MENU, MENU]), [0] * 5 + [1, 1]),):
        got = [x for g in measured(pa.array([text])) for x in line_crf.line_labels(g, weights, steps).tolist()]
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_crf.judge(none).count() == 0 and line_crf.labelled_lines(none).count() == 0
    rows = spark.createDataFrame([(1, None), (None, "a\n" + SENTENCE)], "doc_id long, text string").selectExpr("*", "1 as labels", "2 as kept")
    assert {r.doc_id: len(r.labels) for r in line_crf.labelled_lines(rows).collect()} == {1: 1, None: 2}
