"""Quality rules: a linear-chain CRF marks lines as content or boilerplate.

Every line gets densities (symbols, capitals, bars, repeats, ...); a linear-chain conditional
random field with two labels scores them and the change of label from line to line; Viterbi
decoding gives the best labelling of a whole document.  A document is kept if the content lines
hold at least ``MIN_SHARE`` of its words' characters and the base rules don't fail it.  The field is
trained on single lines whose labels are known (``line_crf_training``), never on documents' labels.

Defined results: a null or empty text has no words, so the base rules fail it; repeated rows are
judged alike, each by itself; an empty table gives an empty result; other columns are ignored.  A
very long text is a group by itself: about 40 bytes for each of its bytes, and time in proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.llm.wordstats import COUNTS, Group, measured

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MIN_SHARE = 0.5

FEATURES = ("bias", "symbols", "capitals", "digits", "shouts", "bars", "repeats", "same_words", "duplicate", "short", "unstopped", "long", "single")
# Fitted by line_crf_training on lines planted in documents of the 10,000-document
# table.  Scores are those of boilerplate against content.
WEIGHTS = (-3.033, 10.672, 0.561, 19.296, 9.573, 0.896, -0.089, 2.234, 6.035, -4.176, 10.538, -3.795, -0.357)
#: TRANSITIONS[a][b]: score of label b (0 content, 1 boilerplate) after label a.
TRANSITIONS = ((-0.29, -1.134), (-0.585, 2.01))


def line_features(group: Group) -> np.ndarray:
    """One row of FEATURES per line, each within 0 and 1."""
    of = {name: group.lines[:, k] for k, name in enumerate(COUNTS)}
    words, chars, letters = np.maximum(of["words"], 1), np.maximum(of["word_chars"], 1), np.maximum(of["letters"], 1)
    columns = [
        np.ones(len(words)),
        np.minimum(1, 10 * of["symbols"] / chars),
        of["capitals"] / letters,
        of["digits"] / chars,
        np.minimum(1, of["shouts"] / words),
        np.minimum(1, of["bars"] / words),
        of["repeats"] / words,
        of["same_words"] / words,
        group.line_dup.astype(float),
        (of["words"] < 3).astype(float),
        # Scripts of mostly three bytes a character have stops of their own.
        ((of["stops"] == 0) & (of["bytes"] < 2 * np.maximum(of["chars"], 1))).astype(float),
        np.minimum(1, of["words"] / 20),
        np.repeat(group.n_lines == 1, group.n_lines).astype(float),
    ]
    return np.clip(np.stack(columns, axis=1), 0, 1)


def viterbi(scores: list[float], transitions=TRANSITIONS) -> list[int]:
    """The best labels of one document's lines, given each line's score for boilerplate."""
    (cc, cb), (bc, bb) = transitions
    content, boiler = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        from_c, from_b = content >= boiler + bc - cc, content + cb > boiler + bb
        back.append((0 if from_c else 1, 0 if from_b else 1))
        content, boiler = (content + cc if from_c else boiler + bc), (content + cb if from_b else boiler + bb) + s
    label = int(boiler > content)
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def line_labels(group: Group, weights=WEIGHTS, transitions=TRANSITIONS) -> np.ndarray:
    """0 (content) or 1 (boilerplate) for every line of the group."""
    scores = (line_features(group) @ np.asarray(weights)).tolist()
    labels, at = [], 0
    for n in group.n_lines.tolist():
        labels += viterbi(scores[at : at + n], transitions)
        at += n
    return np.array(labels, dtype=np.int64)


def verdicts(group: Group) -> dict[str, np.ndarray]:
    """The contract's columns, and content_share."""
    labels = line_labels(group)
    n = len(group.docs)
    of = {name: group.docs[:, k].astype(np.int64) for k, name in enumerate(COUNTS)}
    content = np.bincount(group.line_doc, weights=group.lines[:, COUNTS.index("word_chars")] * (labels == 0), minlength=n)
    share = content / np.maximum(1, of["word_chars"])
    failed = (of["words"] < MIN_WORDS) | (100 * of["repeats"] > MAX_REPEATED_PERCENT * of["words"])
    return {"n_words": of["words"], "word_chars": of["word_chars"], "n_symbols": of["symbols"], "n_dup_lines": group.n_dup_lines, "n_repeat_words": of["repeats"], "base_failed": failed, "kept": ~failed & (share >= MIN_SHARE), "content_share": share}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in measured(batch.column(1)):
                found = verdicts(group)
                ids = batch.column(0).slice(at, len(group.docs))
                at += len(group.docs)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def labelled_lines(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text) its lines' labels: doc_id, labels array<int>, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in measured(batch.column(1)):
                labels, ends = line_labels(group), np.cumsum(group.n_lines)
                ids = batch.column(0).slice(at, len(group.docs))
                at += len(group.docs)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(labels, pa.int32()))], names=["doc_id", "labels"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, labels array<int>")


def fit(features: np.ndarray, lengths: np.ndarray, truth: np.ndarray, rounds: int = 3000, rate: float = 0.5, shrink: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood of the CRF's weights and transitions by accelerated
    gradient ascent (Nesterov), on the mean of the lines with a small penalty of squares.

    features: lines x FEATURES; lengths: lines of each document; truth: 0 or 1 per line.
    """
    n, most = len(lengths), int(lengths.max())
    place = np.repeat(np.arange(n), lengths), np.arange(len(truth)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.zeros((n, most), dtype=bool)
    there[place] = True
    label = np.zeros((n, most), dtype=int)
    label[place] = truth
    pairs = there[:, 1:]
    seen = np.array([[(pairs & (label[:, :-1] == a) & (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    weights, steps = np.zeros(features.shape[1]), np.zeros((2, 2))
    was = weights, steps
    for turn in range(rounds):
        push = turn / (turn + 3)
        (weights, steps), was = (weights + push * (weights - was[0]), steps + push * (steps - was[1])), (weights, steps)
        score = np.zeros((n, most, 2))
        score[place[0], place[1], 1] = features @ weights
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            forward[:, t] = score[:, t] + np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1])
        for t in range(most - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp(ahead[:, :1] + steps[:, 0], ahead[:, 1:] + steps[:, 1]), 0)
        total = np.logaddexp(*np.moveaxis(forward + backward, 2, 0))
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total)[place]
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = forward[:, :-1, a] + steps[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, 1:]
                expected[a, b] = np.exp(joint[pairs]).sum()
        weights = weights + rate * (features.T @ (truth - chance) / len(truth) - shrink * weights)
        steps = steps + rate * ((seen - expected) / len(truth) - shrink * steps)
    return weights, steps
