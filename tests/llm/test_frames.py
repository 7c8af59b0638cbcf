"""Token frames: rolled files, access by document over a manifest, ties and nulls over files."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fslink.llm import token_frames as T
from tests.llm.test_operators import ROWS, SCHEMA


@pytest.fixture(scope="module")
def many():
    rows = [(None if k % 4 == 0 else 7 if k % 4 == 1 else k, f"text number {k} " * (k % 5)) for k in range(200)]
    return [*rows, (10**12, None), (-3, "below zero"), (7, "same"), (7, "same")]


@pytest.mark.parametrize("limits", [{"file_docs": 9}, {"file_bytes": 200}, {}])
def test_files_roll_and_documents_are_found(spark, many, tmp_path, limits):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of = {text: np.array(full.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes() for _, text in many}
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    manifest = T.write_frames(docs, f"file://{tmp_path}/frames", files=4, **limits)
    if "file_docs" in limits:
        assert all(n <= 9 for _, _, n, *_ in manifest) and len(manifest) >= len(many) // 9
    if "file_bytes" in limits:
        assert len(manifest) > 8
    got = T.read_frames(spark, manifest, with_ids=True).collect()
    key = lambda d: (d is not None, d or 0)
    assert sorted((key(r.doc_id), bytes(r.ids)) for r in got) == sorted((key(d), of[t]) for d, t in many)
    rows = sorted(got, key=lambda r: r.start)
    assert [key(r.doc_id) for r in rows] == sorted(key(d) for d, _ in many)
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist() and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
    for doc in (None, 7, -3, 10**12, 2, 5):
        assert sorted(T.lookup(manifest, doc)) == sorted(of[t] for d, t in many if d == doc)


def test_a_reader_takes_only_what_it_needs():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    sink = io.BytesIO()
    writer = T.FrameWriter(sink)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50_000, 5000).astype("<u4").tobytes() for _ in range(50)]
    for k, p in enumerate(parts):
        writer.add(2 * k, p)
    writer.close()
    raw = sink.getvalue()
    source = Counting(raw)
    reader = T.FrameReader(source, len(raw))
    assert reader.get(40) == [parts[20]] and reader.get(41) == [] and source.taken < len(raw) / 20


def test_empty_and_edge_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert T.write_frames(none, f"file://{tmp_path}/none") == [] and T.round_trip(none).count() == 0
    rows = T.round_trip(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as part", "2 as path", "3 as start")).collect()
    assert len(rows) == len(ROWS)
