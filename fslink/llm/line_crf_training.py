"""Training of the line CRF on lines whose labels are known because they were planted.

Content lines are those of documents of good quality.  Among them runs of boilerplate are planted,
made of the document's own words: menus, trails, shouts, lines full of symbols, lists of short
entries, notices, counters and echoes of an earlier line.  Some documents are boilerplate altogether, some
begin with a line of content.  A line's label is whether it was planted; no document's label is one.

``python -m fslink.llm.line_crf_training FOLDER`` fits the weights and transitions on the documents
and labels below FOLDER, prints them, and the accuracy on planted lines of documents held out.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.llm.line_crf import FEATURES, fit, line_features, line_labels
from fslink.llm.wordstats import WORD, measured

#: Documents of good quality that are learnt from, at most; the first by a hash of their text.
SAMPLE_DOCS = 3000
SEED = 5
#: Share of documents made of boilerplate altogether.
WHOLLY = 0.25
#: Characters of a document beyond which it isn't used for planting.
LONGEST = 8000

# What such lines say on web pages.
ENTRIES = "Home About Contact Login Search Share Print Archive Next Previous Subscribe Facebook Twitter Sitemap Help Imprint".split()
NOTICES = ("© 2019 {} {}. All rights reserved", "Share this: Facebook | Twitter | {}", "Read more: {} {} {}", "Posted by {} on 12/03/2014 at 10:22", "Tags: {}, {}, {}", "Click here to log in or register | {}")


def _words(rng: random.Random, words: Sequence[str], least: int, most: int, stops: str = ".,") -> list[str]:
    return [rng.choice(words).strip(stops) or "x" for _ in range(rng.randint(least, most))]


def boilerplate(rng: random.Random, words: Sequence[str], above: Sequence[str], length: int) -> list[str]:
    """A run of ``length`` lines of one kind; ``above`` are lines that stand before it."""
    kind = rng.randrange(8)
    names = lambda: rng.choice([_words(rng, words, 3, 40, ""), _words(rng, words, 3, 9), rng.sample(ENTRIES, rng.randint(3, 6))])
    if kind == 0:
        return [" | ".join(names()) for _ in range(length)]
    if kind == 1:
        return [" > ".join(names()[:5]) for _ in range(length)]
    if kind == 2:
        return [" ".join(w.upper() + rng.choice(("!!", "!", "!!!")) for w in _words(rng, words, 3, 40, "")) for _ in range(length)]
    if kind == 3:
        return [" ".join(w + 3 * rng.choice("#*$%&") for w in _words(rng, words, 3, 60, "")) for _ in range(length)]
    if kind == 4:
        return [rng.choice((rng.choice(ENTRIES), " ".join(_words(rng, words, 1, 2)))) for _ in range(length + 2)]
    if kind == 5:
        return [rng.choice(NOTICES).format(*_words(rng, words, 3, 3)) for _ in range(length)]
    if kind == 6:
        return [" ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(2, 8))) for _ in range(length)]
    echoed = [x for x in above if WORD.search(x)]
    return [rng.choice(echoed)] * (length + 1) if echoed else boilerplate(rng, words, above, length)


def planted(text: str, seed: int = SEED) -> tuple[str, list[int]]:
    """The text with boilerplate planted in it, and the label of each of its lines."""
    rng = random.Random(f"{seed}:{text}")
    lines = text.split("\n")
    words = WORD.findall(text) or ["x"]
    if rng.random() < WHOLLY:
        lead = lines[:1] if rng.random() < 0.5 and len(lines) > 1 else []
        rest: list[str] = []
        while len(rest) < max(2, len(lines)):
            rest += boilerplate(rng, words, rest, rng.randint(1, 6))
        return "\n".join(lead + rest), [0] * len(lead) + [1] * len(rest)
    labels = [0] * len(lines)
    for _ in range(rng.choice((0, 1, 1, 2, 3))):
        at = rng.choice((0, len(lines), rng.randint(0, len(lines))))
        run = boilerplate(rng, words, lines[:at], rng.randint(1, 4))
        lines[at:at] = run
        labels[at:at] = [1] * len(run)
    return "\n".join(lines), labels


def examples(texts: Sequence[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, lines per document, true labels and the CRF's present labels of planted texts."""
    made = [planted(t, seed) for t in texts]
    features, lengths, now = [], [], []
    for group in measured(pa.array([t for t, _ in made], pa.string())):
        features.append(line_features(group))
        lengths.append(group.n_lines)
        now.append(line_labels(group))
    return np.concatenate(features), np.concatenate(lengths), np.concatenate([x for _, x in made]), np.concatenate(now)


def good_documents(docs: DataFrame, labels: DataFrame, held_out: bool, sample: int = SAMPLE_DOCS) -> list[str]:
    """Texts of at most ``sample`` documents of good quality, of those held out or the others."""
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    side = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return [r.text for r in rows.where(side == F.lit(held_out)).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(sample).collect()]


def accuracy(texts: Sequence[str], seed: int = SEED) -> tuple[float, float]:
    """Share of lines labelled rightly, and share of the partly planted documents that get both labels."""
    _, lengths, truth, now = examples(texts, seed)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    mixed = lambda x: np.bincount(doc, weights=x, minlength=len(lengths)) % lengths > 0
    both = mixed(truth)
    return float((truth == now).mean()), float((mixed(now) & both).sum() / max(1, both.sum()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the CRF."""
    features, lengths, truth, _ = examples(good_documents(docs, labels, False, sample))
    return fit(features, lengths, truth)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    tables = [spark.read.parquet(f"{sys.argv[1]}/{name}.parquet") for name in ("documents", "labels")]
    weights, steps = train(*tables)
    print(dict(zip(FEATURES, weights.round(3).tolist())), steps.round(3).tolist())
    print("accuracy, mixed documents:", accuracy(good_documents(*tables, True)))
