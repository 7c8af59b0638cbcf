"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a bounded sample of labelled rows come to the driver, where trees are grown on
binned features (sums of gradients and curvatures per bin, best split first).  All trees are then
flattened into five arrays, and every task scores its documents by moving all (document, tree)
pairs down one level at a time with numpy.

Defined results: a null text counts as empty and gets a score like any other; repeated rows get
the same score; a null id is never held out; without labels of both kinds the score is the share
of label 1, or 0.5 without any; an empty table gives an empty result; other columns are ignored.  A
very long text is a group by itself: about 40 bytes for each of its bytes, and time in proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fslink.llm.wordstats import COUNTS, Group, measured

#: Most labelled rows whose statistics are gathered to fit the trees (about 120 bytes each).
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
HELD_OUT_OF = 4
HELD_OUT_IS = 2

TREES = 60
LEAVES = 12
BINS = 64
RATE = 0.15
RIDGE = 1.0
LEAST_CURVATURE = 2.0

FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "shouts", "bars", "stops", "repeats", "same_words", "duplicate_lines", "log_lines", "letters", "line_words")


def document_features(group: Group) -> np.ndarray:
    """One row of FEATURES per document."""
    of = {name: group.docs[:, k] for k, name in enumerate(COUNTS)}
    words, chars = np.maximum(of["words"], 1), np.maximum(of["word_chars"], 1)
    columns = [
        np.log1p(of["words"]), of["word_chars"] / words, of["symbols"] / chars, of["capitals"] / np.maximum(of["letters"], 1),
        of["digits"] / chars, of["shouts"] / words, of["bars"] / words, of["stops"] / words, of["repeats"] / words,
        of["same_words"] / words, group.n_dup_lines / group.n_lines, np.log1p(group.n_lines), of["letters"] / chars, of["words"] / group.n_lines,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """All trees in five arrays; a node without children points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        margin = np.full(len(features), self.base)
        if len(self.roots):
            rows = np.arange(len(features))[:, None]
            node = np.tile(self.roots, (len(features), 1))
            for _ in range(self.depth):
                node = np.where(features[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            margin += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def fit(features: np.ndarray, label: np.ndarray, trees: int = TREES, leaves: int = LEAVES, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts logistic loss; ``label`` is 0 or 1 per row of ``features``."""
    nothing = np.zeros(0)
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        base = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Trees(nothing, nothing, nothing, nothing, nothing, nothing, 0, float(base))
    n, m = features.shape
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in features.T]
    binned = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, features.T)], axis=1)
    cells = binned + np.arange(m) * bins
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    out: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots, deepest = [], 0

    def best(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[float, int, int]:
        flat = cells[rows].ravel()
        g = np.bincount(flat, weights=np.repeat(slope[rows], m), minlength=m * bins).reshape(m, bins).cumsum(axis=1)
        h = np.bincount(flat, weights=np.repeat(curve[rows], m), minlength=m * bins).reshape(m, bins).cumsum(axis=1)
        gt, ht = g[:, -1:], h[:, -1:]
        gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(h < LEAST_CURVATURE) | (ht - h < LEAST_CURVATURE)] = 0
        for k, c in enumerate(cuts):
            gain[k, len(c) :] = 0
        k = int(gain.argmax())
        return float(gain.flat[k]), k // bins, k % bins

    def node(rows, slope, curve) -> int:
        for k, v in (("feature", 0), ("limit", 0.0), ("left", len(out["left"])), ("right", len(out["right"])), ("value", -rate * slope[rows].sum() / (curve[rows].sum() + RIDGE))):
            out[k].append(v)
        return len(out["value"]) - 1

    for _ in range(trees):
        chance = _sigmoid(margin)
        slope, curve = chance - label, chance * (1 - chance)
        top = np.arange(n)
        roots.append(node(top, slope, curve))
        open_ = [(*best(top, slope, curve), roots[-1], top, 0)]
        kept = 1
        while kept < leaves and open_:
            gain, f, b, at, rows, level = open_.pop(max(range(len(open_)), key=lambda i: open_[i][0]))
            if gain <= 1e-6:
                break
            goes = binned[rows, f] <= b
            out["feature"][at], out["limit"][at] = f, float(cuts[f][b])
            for side, part in (("left", rows[goes]), ("right", rows[~goes])):
                child = node(part, slope, curve)
                out[side][at] = child
                open_.append((*best(part, slope, curve), child, part, level + 1))
            kept, deepest = kept + 1, max(deepest, level + 1)
        model = Trees(*(np.array(out[k]) for k in out), np.array(roots[-1:]), deepest, 0.0)
        p = model.scores(features)
        margin += np.log(p / (1 - p))
    return Trees(*(np.array(out[k]) for k in out), np.array(roots), deepest, base)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: rows where it is 2 are held out of learning."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(HELD_OUT_OF))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits the trees on at most ``sample_rows`` labelled rows (doc_id, quality) that aren't held
    out, taken in the order of a hash of their id; of the texts of one id the first by a hash counts."""
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != HELD_OUT_IS)).select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # Of repeated ids one text stays, the first by a hash, so the sample is bounded by its labels.
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "first.text", "quality")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in measured(batch.column(1)):
                found = document_features(group)
                n = len(found)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).cast(pa.int64()), flat, batch.column(2).slice(at, n).cast(pa.int32())], names=["doc_id", "features", "quality"])
                at += n

    got = rows.mapInArrow(run, "doc_id long, features array<double>, quality int").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    features = np.array(got.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    # Ties in doc_id: the rows' order doesn't depend on the tasks'.
    order = np.lexsort((*features.T, got.column("quality").to_numpy(), got.column("doc_id").to_numpy()))
    return fit(features[order], got.column("quality").to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in measured(batch.column(2)):
                found = model.scores(document_features(group))
                head = [batch.column(k).slice(at, len(found)) for k in (0, 1)]
                at += len(found)
                yield pa.RecordBatch.from_arrays([*head, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT_IS, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, all their columns as they were."""
    at_text = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(document_features(group)) for group in measured(batch.column(at_text))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
