"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout (the public seekable zstandard format, so any zstandard tool can read it):

* one frame per document: its ids as little-endian unsigned 32-bit integers, with the content size
  and a content checksum in the frame;
* a skippable frame (magic 0x184D2A50): the documents' ids as little-endian signed 64-bit integers,
  then one byte each that is 1 where the id is null;
* the seek table, a skippable frame (magic 0x184D2A5E): per frame its compressed size, its plain size
  and the low 32 bits of the XXH64 of its plain bytes; then the number of frames, a descriptor byte
  (0x80: checksums are there) and the magic number 0x8F92EAB1.

A reader takes the last 9 bytes, then the table, then only the frames it wants: by place (``ids``) or
by document (``get``).  Documents are in ascending order of id within a file and over the files;
``lookup`` finds a document among all files of a manifest.

A file is closed at ``FILE_BYTES`` or ``FILE_DOCS``, so a writer's memory is bounded however much a
task writes.  Each write task makes files of names of their own and reports them; only the files that successful
tasks report are in the manifest, so retried or speculative tasks leave at most unused files.

Defined results: a null text counts as empty, its frame holds the end id alone; a null id sorts
first and comes back as null; repeated rows get frames of their own; rows of one id are in the order of a hash
of their text, and may be in several files; an empty
table gives no file and an empty result; other columns are ignored.  A very long text is encoded and
compressed as one frame, in memory, of less than 2**32 bytes.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fslink.llm.common import partitions, shared_path
from fslink.llm.word_bpe import word_ids

END_ID = 1
LEVEL = 3
FILE_BYTES = 256 << 20
FILE_DOCS = 1_000_000
#: Rows per write task, about, where that gives more tasks than ``TASKS`` per shuffle partition.
TASK_ROWS = 1_000_000
TASKS = 4
# The seekable zstandard format.
IDS_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def _u32(*values: int) -> bytes:
    return np.array(values, dtype="<u4").tobytes()


class FrameWriter:
    """Writes one file; ``sink`` needs only ``write(bytes)``."""

    def __init__(self, sink, level: int = LEVEL):
        import zstandard

        self.sink, self.entries, self.ids, self.null, self.size, self.tokens = sink, array("I"), array("q"), bytearray(), 0, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def __len__(self) -> int:
        return len(self.null)

    def add(self, doc: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compressor.compress(ids)
        self.sink.write(frame)
        self.size += len(frame)
        self.tokens += len(ids) // 4
        self.entries.extend((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc or 0)
        self.null.append(doc is None)

    def close(self) -> None:
        docs = np.array(self.ids, dtype="<i8").tobytes() + bytes(self.null)
        self.sink.write(_u32(IDS_MAGIC, len(docs)) + docs)
        rows = np.array(self.entries, dtype="<u4").tobytes()
        foot = _u32(len(self)) + bytes([HAS_CHECKSUMS]) + _u32(SEEKABLE_MAGIC)
        self.sink.write(_u32(TABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


class FrameReader:
    """Random access to one file; ``source`` needs ``seek`` and ``read``, ``size`` is its length.
    The documents' ids are read when they are first asked for."""

    def __init__(self, source, size: int):
        self.source = source
        count, descriptor, magic = np.frombuffer(self._at(size - 9, 9), dtype=np.dtype([("n", "<u4"), ("d", "u1"), ("m", "<u4")]))[0]
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = size - 9 - 12 * int(count)
        self.entries = np.frombuffer(self._at(table, 12 * int(count)), dtype=_ENTRY)
        ends = np.cumsum(self.entries["packed"], dtype=np.int64)
        self.starts = ends - self.entries["packed"]
        self._end = int(ends[-1]) if count else 0
        self._named = None

    def _names(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids and whether each is null."""
        if self._named is None:
            count = len(self)
            magic, length = np.frombuffer(self._at(self._end, 8), dtype="<u4")
            if magic != IDS_MAGIC or length != 9 * count:
                raise ValueError("the frame of document ids is missing")
            raw = self._at(self._end + 8, int(length))
            self._named = np.frombuffer(raw[: 8 * count], dtype="<i8"), np.frombuffer(raw[8 * count :], dtype="u1").astype(bool)
        return self._named

    @property
    def docs(self) -> list[int | None]:
        return [None if z else int(d) for d, z in zip(*self._names())]

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self, k: int) -> bytes:
        """The k-th document's ids, checked; reads and decompresses its frame only."""
        import xxhash
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.entries["packed"][k])))
        if len(plain) != self.entries["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def get(self, doc: int | None) -> list[bytes]:
        """The ids of every document of this id, found by bisection; null ids stand first."""
        names, null = self._names()
        nulls = int(null.sum())
        first, last = (0, nulls) if doc is None else (nulls + int(np.searchsorted(names[nulls:], doc, side)) for side in ("left", "right"))
        return [self.ids(k) for k in range(first, last)]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: One row per file, in order: place of its first document, path, documents, ids before it, its first and last document.
Manifest = list[tuple[int, str, int, int, int | None, int | None]]


def write_frames(docs: DataFrame, folder: str, end_id: int = END_ID, vocabulary: str = "word_bpe_49k.json", files: int | None = None, file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS) -> Manifest:
    """Encodes documents (doc_id, text) into files below ``folder``, in ascending order of id.

    Returns the manifest.  It grows with the number of files, not of documents.
    """
    spark = docs.sparkSession
    names = ["part", "turn", "path", "docs", "tokens", "first", "last"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer, sink, path, turn, first, last = None, None, "", 0, None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (part, turn, path, len(writer), writer.tokens, first, last)))), schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            encode, end = word_ids(vocabulary).text, end_id.to_bytes(4, "little")
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is not None and (writer.size >= file_bytes or len(writer) >= file_docs):
                    yield closed()
                    writer, turn = None, turn + 1
                if writer is None:
                    store, base = _store(folder)
                    store.create_dir(base, recursive=True)
                    path, first = f"part-{part:06d}-{turn:04d}-{uuid.uuid4().hex}.ids.zst", doc
                    sink = store.open_output_stream(f"{base}/{path}", compression=None)
                    writer = FrameWriter(sink)
                writer.add(doc, encode(text.as_py()) + end)
                last = doc
        if writer is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    tasks = files or max(TASKS * partitions(spark), -(-rows.count() // TASK_ROWS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    written = sorted(dealt.mapInArrow(write, "part int, turn int, path string, docs long, tokens long, first long, last long").collect(), key=lambda r: (r["part"], r["turn"]))
    manifest, place, before = [], 0, 0
    for r in written:
        manifest.append((place, f"{folder}/{r['path']}", r["docs"], before, r["first"], r["last"]))
        place, before = place + r["docs"], before + r["tokens"]
    return manifest


def lookup(manifest: Manifest, doc: int | None) -> list[bytes]:
    """The ids of every document of this id: opens only the files that may hold it, reads their
    tables and its frames."""
    low = lambda x: (x is not None, x or 0)
    found = []
    for _, path, _, _, first, last in manifest:
        if low(first) <= low(doc) <= low(last):
            store, base = _store(path)
            with store.open_input_file(base) as source:
                found += FrameReader(source, source.size()).get(doc)
    return found


def read_frames(spark: SparkSession, manifest: Manifest, with_ids: bool = False) -> DataFrame:
    """Reads every document of the manifest's files back: doc_id, start, n_tokens, ids_crc32 and,
    if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                store, base = _store(path)
                with store.open_input_file(base) as source:
                    reader = FrameReader(source, source.size())
                    docs = reader.docs
                    for first in range(0, len(reader), 2000):
                        rows = []
                        for k in range(first, min(first + 2000, len(reader))):
                            ids = reader.ids(k)
                            rows.append((docs[k], start, len(ids) // 4, zlib.crc32(ids)) + (ids,) * with_ids)
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.createDataFrame(manifest, "place long, path string, docs long, before long, first long, last long")
    dealt = files.repartition(max(1, min(len(manifest), 4 * partitions(spark))), "path")
    return dealt.mapInArrow(read, schema)


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Writes documents below the shared folder and reads the files back."""
    spark = docs.sparkSession
    return read_frames(spark, write_frames(docs, shared_path(spark, "frames"), **how))
