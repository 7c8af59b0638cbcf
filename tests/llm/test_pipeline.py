"""The pipeline's stages over a small table: their contracts, their effects, and each against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fslink.llm import gbt_quality, secret_scan
from fslink.llm.common import cut
from fslink.llm.wordstats import measured
from tests.llm.test_mixing import keyed, plain_mix
from tests.llm.test_operators import ROWS, SCHEMA, _brute_links
from tests.llm.test_secret_battery import plain_spans

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_equal_plain_python(spark):
    """Every stage on what its predecessor kept, row by row."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, kept = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixture", "packing"]

    # Quality: one tree after the other, node by node.
    rows = docs.collect()
    model = gbt_quality.learn(docs, labels)
    import pyarrow as pa

    features = np.concatenate([gbt_quality.document_features(g) for g in measured(pa.array([r.text for r in rows], pa.string()))])
    for r, x in zip(rows, features):
        margin = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if x[model.feature[node]] <= model.limit[node] else model.right[node]
            margin += model.value[node]
        if 1 / (1 + np.exp(-margin)) >= gbt_quality.THRESHOLD:
            kept[r.doc_id] = r
    docs = cut(stages["quality"](spark, docs, DATA), "quality")
    assert docs.columns == columns and sorted(docs.collect()) == sorted(kept.values()) and len(kept) < len(rows)

    # Near-duplicates: all pairs, the least id of each class.
    rows = sorted(kept.values())
    links, root = _brute_links([r.text for r in rows])
    want = [r for k, r in enumerate(rows) if root[k] == k]
    docs = cut(stages["near_duplicates"](spark, docs, DATA), "near")
    assert docs.columns == columns and sorted(docs.collect()) == want and len(want) < len(rows)

    # Secrets: spans replaced from left to right.
    decided = secret_scan.structured_cut(docs)
    clean = {}
    for r in want:
        out, at = [], 0
        for s, _, e in plain_spans(r.text, decided)[1]:
            if s >= at:
                out += [r.text[at:s], secret_scan.REDACTED]
            at = max(at, e)
        clean[r.doc_id] = "".join(out) + r.text[at:]
    docs = cut(stages["secrets"](spark, docs, DATA), "secrets")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != next(w.text for w in want if w.doc_id == r.doc_id))

    # Mixture: whole documents, as often as their source's target asks for.
    times = Counter()
    for doc, _, size, whole, goal, taken, _ in plain_mix(keyed(docs)):
        passes = int(goal // whole) if whole else 0
        extra = taken - passes * size
        times[doc] = (passes + (extra > 0 and 2 * extra >= size)) if size else 0
    docs = cut(stages["mixture"](spark, docs, DATA), "mixture")
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == +times
    assert {r.doc_id: r.text for r in docs.collect()} == {d: clean[d] for d in +times}

    # Packing: every id of every copy once, nothing above the capacity.
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array(full.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for d, t in clean.items()}
    packed = stages["packing"](spark, docs, DATA).collect()
    covered, windows = Counter(), {}
    for r in packed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(d, k): n for d, n in (+times).items() for k in range(len(ids[d]))})
    for parts in windows.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096


def test_stages_take_nulls_ties_empty_tables_and_clashing_names(spark):
    names = "score label held_out node root bucket key tie doc text_ base_spans all_spans size target position turn part begin rank own_id row_hash".split()
    hard = spark.createDataFrame(ROWS, SCHEMA).withColumns({"n_chars": F.length("text").cast("long")} | {c: F.lit(f"own {c}") for c in names})
    for docs in (hard.union(hard), hard.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = cut(stage(spark, docs, DATA), name)
            if name != "packing":
                assert made.columns == hard.columns
                assert all(r[c] == f"own {c}" for r in made.collect() for c in names)
            docs = made
        assert docs.where("length < 1 or offset < 0").count() == 0


def test_accepted_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("extra", F.array(F.lit(1), F.lit(None)))
    model = gbt_quality.learn(docs, spark.createDataFrame([(r[0], int(r[0] != 13), 0) for r in ROWS if r[0]], "doc_id long, quality int, toxic int"))
    all_ = sorted(map(str, docs.collect()))
    assert sorted(map(str, gbt_quality.accepted(docs, model, 0.0).collect())) == all_
    assert gbt_quality.accepted(docs, model, 1.1).count() == 0 and gbt_quality.accepted(docs.limit(0), model).count() == 0
    some = sorted(map(str, gbt_quality.accepted(docs, model).collect()))
    assert set(some) <= set(all_)


def test_queries_are_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", "op1_line_crf", "op10_multiset_hash", "link_batch", "normalise_feed"} <= names
    assert sum(n.startswith("op") for n in names) == 10
    assert {"op4_jaccard_join", "op7_mixing", "op10_multiset_hash"} <= set(__spark_entry__.oracle_sql()) <= names
