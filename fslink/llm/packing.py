"""Packing token pieces into sequences by multiway Karmarkar-Karp differencing.

A document's ids (with its end id) are cut at multiples of the capacity.  Whole pieces fill a
sequence each.  The remainders are packed block by block: every remainder starts as a partition of
its block into ``k`` windows of which one is filled; the two partial partitions with the largest
imbalance are merged again and again, the fullest window of one with the emptiest of the other,
until one near-equal partition is left.  ``k`` is the least number of windows that can hold the block.
What a window has above the capacity is cut off one of its pieces and put where there is room;
if there is none ``k`` rises by one.

Only lengths are shuffled.  A piece brings the checksums of its beginnings at every ``GRID`` ids, so it
can be cut there later and the checksums of both parts follow, without its ids.

Defined results: a null text counts as empty (its document still has the end id), null ids stay
null, repeated rows are packed as separate documents (equal rows, id and text, are dealt to one task), an empty table gives an empty table, other
columns are ignored.  A very long text is encoded in memory: 4 bytes a token, and the text.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.llm.common import cut
from fslink.llm.word_bpe import word_ids

CAPACITY = 4096
END_ID = 2
#: Remainders packed together.  A block's merges take time in proportion to its square.
BLOCK = 1024
#: Blocks in a task.
BLOCKS_A_TASK = 4
#: Ids between places where a remainder may be cut.
GRID = 16
# Fixed value: the polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size in a near-equal partition into ``k`` windows."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes):
        first = np.zeros(k, dtype=np.int64)
        first[0] = size
        sums[i] = first
        heap.append((-int(size), i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-joint, kind="stable")
        joint = joint[order]
        made = n + len(merges)
        merges.append((a, b, order))
        sums[made] = joint
        heapq.heappush(heap, (int(joint[-1] - joint[0]), made))
    # From the last merge down: slot[x] says which final window each window of partition x became.
    slots = {heap[0][1]: np.arange(k)}
    window = np.empty(n, dtype=np.int64)
    for made in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[made - n]
        into = np.empty(k, dtype=np.int64)
        into[order] = slots.pop(made)
        slots[a], slots[b] = into, into[::-1]
    for i in range(n):
        window[i] = slots[i][0]
    return window


def filled(sizes: np.ndarray, capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, int, int, int]]:
    """(item, from, to, window) of every part of the items; no window above ``capacity``, cuts at
    multiples of ``grid`` only, as few windows as can be."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        sums = np.bincount(found, weights=sizes, minlength=k).astype(np.int64)
        parts = {i: (i, 0, int(size), int(w)) for i, (size, w) in enumerate(zip(sizes, found))}
        loose = []
        for w in np.flatnonzero(sums > capacity):
            members = np.flatnonzero(found == w)
            i = int(members[sizes[members].argmax()])
            stay = max(0, (int(sizes[i]) - int(sums[w] - capacity)) // grid * grid)
            loose.append((i, stay, int(sizes[i])))
            sums[w] -= int(sizes[i]) - stay
            if stay:
                parts[i] = (i, 0, stay, int(w))
            else:
                del parts[i]
        out = [*parts.values()]
        room = [(-int(capacity - s), w) for w, s in enumerate(sums) if s < capacity]
        heapq.heapify(room)
        loose.sort(key=lambda x: x[1] - x[2])
        while loose and room:
            i, a, b = loose.pop(0)
            free, w = heapq.heappop(room)
            fits = min(b - a, -free if b - a <= -free else -free // grid * grid)
            if fits <= 0:  # not even the roomiest window takes a part
                loose.insert(0, (i, a, b))
                break
            out.append((i, a, a + fits, w))
            if -free - fits > 0:
                heapq.heappush(room, (free + fits, w))
            if a + fits < b:
                loose.insert(0, (i, a + fits, b))
        if not loose:
            return out
        k += 1


def _shifts() -> list[list[int]]:
    """For each power of two bytes the 32 columns of the matrix that appends so many zero bytes."""
    m = [POLYNOMIAL, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        m = [_times(m, c) for c in m]
    out = []
    for _ in range(32):
        out.append(m)
        m = [_times(m, c) for c in m]
    return out


def _times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


_SHIFTS = _shifts()


def checksum_between(before: int, whole: int, length: int) -> int:
    """The CRC-32 of the last ``length`` bytes of what has the checksum ``whole``, given that of what
    stands before them."""
    k = 0
    while length:
        if length & 1:
            before = _times(_SHIFTS[k], before)
        length >>= 1
        k += 1
    return whole ^ before


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "word_bpe_49k.json", grid: int = GRID) -> DataFrame:
    """The pieces of each document's ids: doc_id, start, length, ids_crc32, doc_tokens, and grid, the
    checksums of a remainder's beginnings at every ``grid`` ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grid binary"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grid"]
    types = [pa.int64()] * 5 + [pa.binary()]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(vocabulary).text, end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                total = len(ids) // 4
                for s in range(0, total, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    check, marks = 0, array("I")
                    if len(part) == 4 * capacity:
                        check = zlib.crc32(part)
                    else:
                        for at in range(0, len(part), 4 * grid):
                            check = zlib.crc32(part[at : at + 4 * grid], check)
                            marks.append(check)
                    rows.append((doc, s, len(part) // 4, check, total, marks.tobytes()))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, grid: int = GRID) -> DataFrame:
    """The pieces (as of ``token_pieces``), some of them cut once more, with sequence_id and offset:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows are dealt by a hash of what they are, sorted in each task and packed in
    blocks, so a rerun gives the same sequences.  Offsets in a sequence are gapless from 0.
    """
    table = cut(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "grid"), "pieces")
    tasks = max(1, table.count() // (block * BLOCKS_A_TASK))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        used = 0

        def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal used
            start, sizes, check = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            whole, rest = np.flatnonzero(sizes >= capacity), np.flatnonzero(sizes < capacity)
            parts = [(int(i), 0, capacity, n) for n, i in enumerate(whole)]
            if len(rest):
                found = filled(sizes[rest], capacity, grid)
                _, dense = np.unique([w for *_, w in found], return_inverse=True)
                parts += [(int(rest[i]), a, b, len(whole) + int(w)) for (i, a, b, _), w in zip(found, dense)]
            parts.sort(key=lambda p: (p[3], p[0], p[1]))
            item, begin, end, seq = (np.array(c, dtype=np.int64) for c in zip(*parts))
            length = end - begin
            checks = check[item].copy()
            for n in np.flatnonzero(length < sizes[item]):
                marks = np.frombuffer(rows.column(5)[int(item[n])].as_py(), dtype="<u4")
                upto = lambda x, n=n, marks=marks: 0 if x == 0 else int(check[item[n]]) if x == sizes[item[n]] else int(marks[x // grid - 1])
                checks[n] = checksum_between(upto(int(begin[n])), upto(int(end[n])), 4 * int(length[n]))
            ends = np.cumsum(length)
            heads = np.r_[True, np.diff(seq) != 0]
            offset = ends - length - np.maximum.accumulate(np.where(heads, ends - length, 0))
            out = [rows.column(0).take(pa.array(item)), pa.array(start[item] + begin), pa.array(length), pa.array(checks), rows.column(4).take(pa.array(item)), pa.array(first + used + seq), pa.array(offset)]
            used += int(seq[-1]) + 1
            return pa.RecordBatch.from_arrays(out, names=names)

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            while waiting >= 2 * block:  # the last block has one to two times the rows
                rows = joined()
                yield packed(rows.slice(0, block))
                held, waiting = [rows.slice(block)], waiting - block
        if waiting:
            yield packed(joined())

    order = ["doc_id", "start", "length", "ids_crc32"]
    key = F.xxhash64(*order)
    dealt = table.repartition(tasks, key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(place, ", ".join(f"{n} long" for n in names))
