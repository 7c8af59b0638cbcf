"""N-gram Jaccard join with Bayesian candidate pruning.

1.  Every document's distinct runs of five words are hashed; ``HASHES`` MinHash values (16 bits
    each) sketch the set.  Documents of the same words are one text from here on.
2.  Texts that agree on all ``ROWS`` values of one of ``BANDS`` bands share a bucket.  Pairs in a bucket compare
    their MinHash values a step at a time; a pair is dropped as soon as the posterior chance that
    its similarity reaches the threshold falls below ``TOLERANCE`` (uniform prior: the chance that a
    binomial variable of n + 1 trials is at most the s matches so far).  What survives links texts
    into candidate groups; only a spanning forest of them is written, never all pairs.  In a bucket
    of more than ``BUCKET_BLOCK`` texts all meet the bucket's first text; those that survive are linked
    already and need not meet each other, only those that don't, in blocks.
3.  Each candidate group's texts come together with their shingles.
    Every pair is pruned in the same way and the rest verified by exact intersection.  A block
    reports counts of links per text and a spanning forest.  In a group of more than ``GROUP_BLOCK``
    texts a centre is formed, the shingles that most of a sample of its texts have.  Jaccard distance is
    a metric, so two texts within half the greatest distance of the centre are linked for sure:
    they are counted without meeting.  The others meet everyone, in blocks.
4.  Connected components of the verified links give the classes.

So a group of near copies costs time in proportion to its size, but for those of its texts that lie
far from its centre; each of these is compared with the whole group, as exact counts of links demand.

A pair of similarity 0.8 is missed by all bands with a chance below 1e-4, less for closer pairs.
Texts are known by a 64-bit hash of their words; two of a billion different texts share one with a
chance of about 3 %.

Defined results: a document without words (null, empty, white space) has no shingle, so no link and
a class of its own; one of fewer than five words has one shingle, all its words; a null id is kept
as null; repeated rows are copies of each other; an empty table gives an empty result; other columns
are ignored, or carried along by ``one_of_each`` whatever their names.  A very long text takes memory for its
shingles: 8 bytes a word where it is compared, about 40 bytes for each of its bytes where it is sketched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.llm.common import cut
from fslink.llm.wordstats import Spans, groups, mix, words

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
STEPS = (20, 40, 80, 120)
TOLERANCE = 1e-4
BUCKET_BLOCK = 256
GROUP_BLOCK = 128
#: Texts of a large group that its centre is formed of, about; any set serves, a good one saves time.
CENTRE_SAMPLE = 32
#: Rows of one bucket or group that a task joins with the facts about it, about.
SALT_ROWS = 4096
#: Pairs verified one by one; more in a block are counted by matrix products.
SINGLE_PAIRS = 64
COLUMNS = 2048

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]
_FACTORS = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def least_matches(steps=STEPS, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the least matches among its first values with which a pair stays."""
    t, out = threshold[0] / threshold[1], []
    for n in steps:
        below, s = 0.0, 0
        while True:  # below: chance of at most s successes in n + 1 trials
            below += math.comb(n + 1, s) * t**s * (1 - t) ** (n + 1 - s)
            if below >= tolerance or s == n:
                break
            s += 1
        out.append(s)
    return out


_LEAST = least_matches()


def survivors(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mask of the pairs (i, j) of rows of ``sketch`` that no step drops."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int32)
    done = 0
    for n, least in zip(STEPS, _LEAST):
        matches += (sketch[i[left], done:n] == sketch[j[left], done:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        left, matches, done = left[stay], matches[stay], n
    mask = np.zeros(len(i), dtype=bool)
    mask[left] = True
    return mask


def shingles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts: each text's node (0 without words), the offsets of its shingles, and all
    shingles, distinct and sorted within a text."""
    for first, last, data, offsets in groups(texts):
        n = last - first
        starts, ends, doc, _ = words(data, offsets)
        hashes = Spans(data, offsets).hashes(starts, ends)
        count = np.bincount(doc, minlength=n)
        begin = np.cumsum(count) - count
        m = max(0, len(hashes) - SHINGLE + 1)
        run = np.zeros(m, dtype=np.uint64)
        for k in range(SHINGLE):
            run += hashes[k : k + m] * _FACTORS[k]
        inside = doc[:m] == doc[SHINGLE - 1 :] if m else np.zeros(0, bool)
        value, owner = mix(run[inside]), doc[:m][inside]
        # The words of a whole text as one number: its node, and the shingle of short texts.
        place = (np.arange(len(hashes)) - begin[doc]).astype(np.uint64)
        whole = np.zeros(n, dtype=np.uint64)
        np.add.at(whole, doc, mix(hashes + mix(place + np.uint64(1))))
        whole = mix(whole + count.astype(np.uint64))
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        value, owner = np.concatenate([value, whole[short]]), np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
        yield np.where(count > 0, whole, 0), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), value


def minhash(offsets: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A row of HASHES 16-bit values per text; texts without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), dtype=np.uint16)
    there = np.flatnonzero(np.diff(offsets))
    if len(there):
        heads = offsets[there]
        for k in range(HASHES):
            least = np.minimum.reduceat(value * _TIMES[k] + _PLUS[k], heads)
            out[there, k] = (least >> np.uint64(24)).astype(np.uint16)  # the high bits are small in a minimum
    return out


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for node, offsets, value in shingles(batch.column(2)):
            n = len(node)
            flat = minhash(offsets, value).tobytes()
            sketch = pa.array([flat[2 * HASHES * i : 2 * HASHES * (i + 1)] for i in range(n)], pa.binary())
            nodes = pa.array(node.view(np.int64), mask=np.diff(offsets) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), nodes, sketch], names=["doc_id", "row_hash", "node", "sketch"])
            at += n


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n vertices, given edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that rows equal in the first ``keys`` columns (they follow each other)
    are in one batch."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined() if len(held) > 1 else batch
        last = _heads(rows, keys)[-1]
        if last:
            yield rows.slice(0, last)
            held = [rows.slice(last)]
        else:
            held = [rows]
    if held:
        yield joined()


def _heads(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for k in range(keys):
        x = rows.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, low, high, block, node, sketch), sorted: a spanning forest of the pairs that
    survive in each bucket."""
    for rows in _whole_groups(batches, 3):
        heads = _heads(rows, 3)
        n = rows.num_rows
        size = np.diff(np.append(heads, n))
        group = np.repeat(np.arange(len(heads)), size)
        left = np.repeat(heads + size, size) - np.arange(n)  # rows of the group from here on
        low, high, block, node = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        sketch = _matrix(rows.column(5))
        label = np.arange(n)
        found: list[np.ndarray] = []
        for d in range(1, int(size.max())):
            i = np.flatnonzero(left > d)
            j = i + d
            # Pairs of the same block belong to the block by itself; linked ones need no more tests.
            new = (label[i] != label[j]) & ((low[i] == high[i]) | (block[i] != block[j])) & (node[i] != node[j])
            i, j = i[new], j[new]
            stay = survivors(sketch, i, j)
            i, j = i[stay], j[stay]
            if len(i):
                root = connected(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, label]))
                joined = root[label] != label
                ends = np.unique(label[joined])
                found.append(np.stack([node[ends], node[root[ends]]], axis=1))
                label = root
        if found:
            edges = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(edges.min(axis=1)), pa.array(edges.max(axis=1))], names=["a", "b"])


def _intersections(parts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sorted distinct arrays."""
    if len(i) <= SINGLE_PAIRS:
        return np.array([len(np.intersect1d(parts[a], parts[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    size = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), size)
    _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(parts), len(parts)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(parts), COLUMNS), dtype=np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        both += dense @ dense.T
    return both[i, j].astype(np.int64)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, low, high, block, node, copies, sketch, shingles), sorted: per text with a
    link in its block, its links (copies counted) and the root of its part of the forest."""
    up, down = THRESHOLD
    for rows in _whole_groups(batches, 3):
        heads = np.append(_heads(rows, 3), rows.num_rows)
        out_node, out_links, out_root = [], [], []
        for first, last in zip(heads[:-1], heads[1:]):
            part = rows.slice(first, last - first)
            low, high, block, node, copies = (part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            m = len(node)
            i, j = np.triu_indices(m, 1)
            if low[0] != high[0]:
                apart = block[i] != block[j]
                i, j = i[apart], j[apart]
            stay = survivors(_matrix(part.column(6)), i, j)
            i, j = i[stay], j[stay]
            if not len(i):
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column(7).to_pylist()]
            size = np.array([len(x) for x in sets])
            both = _intersections(sets, i, j)
            link = down * both >= up * (size[i] + size[j] - both)
            i, j = i[link], j[link]
            if not len(i):
                continue
            links = np.bincount(i, weights=copies[j], minlength=m) + np.bincount(j, weights=copies[i], minlength=m)
            root = connected(m, i, j)
            some = np.flatnonzero(links)
            out_node.append(node[some])
            out_links.append(links[some].astype(np.int64))
            out_root.append(node[root[some]])
        if out_node:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_links, out_root)], names=["node", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the edges (a, b): root is the same within a component only.

    Each round every vertex points to its least neighbour and the graph is contracted along the
    pointers, so the edges dwindle; the tables of each round are written, not kept as lineage.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        to = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("from"), F.least("a", "least").alias("to")), "pointers")
        one = edges.join(to, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        two = one.join(to, F.col("b") == F.col("from")).select("a", F.col("to").alias("b")).where("a <> b")
        label = cut(label.join(to, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        edges = cut(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return label


def _near_leader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, members, node, leader, sketch, leader_sketch): whether each text survives
    beside its bucket's leader."""
    for batch in batches:
        n = batch.num_rows
        if n:
            both = np.concatenate([_matrix(batch.column(4)), _matrix(batch.column(5))])
            tight = survivors(both, np.arange(n), np.arange(n, 2 * n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(tight)], names=["bucket", "members", "node", "leader", "sketch", "tight"])


def _centres(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, members, shingles), sorted: per cluster the shingles of more than half of them."""
    for rows in _whole_groups(batches, 1):
        heads = np.append(_heads(rows, 1), rows.num_rows)
        made = []
        for first, last in zip(heads[:-1], heads[1:]):
            value, times = np.unique(np.frombuffer(b"".join(rows.column(2).slice(first, last - first).to_pylist()), dtype=np.uint64), return_counts=True)
            made.append(value[2 * times > last - first].tobytes())
        yield pa.RecordBatch.from_arrays([rows.column(0).take(heads[:-1]), rows.column(1).take(heads[:-1]), pa.array(made, pa.binary())], names=["cluster", "members", "centre"])


def _near_centre(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, members, node, copies, sketch, shingles, centre): whether each text lies within
    half the greatest distance of a link from the centre."""
    up, down = THRESHOLD
    for batch in batches:
        tight = []
        for own, centre in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            a, b = np.frombuffer(own, dtype=np.uint64), np.frombuffer(centre or b"", dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - both
            tight.append(2 * down * (union - both) <= (down - up) * union)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(tight, pa.bool_())], names=["cluster", "members", "node", "copies", "sketch", "shingles", "tight"])


def _beside(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Gives each row (key, members, node, ...) the facts (key, members, ...) of its key, or nulls;
    the rows of a large key are spread over several tasks."""
    salts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("members")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), salts).cast("int")).join(spread, [key, "salt"], "left").drop("salt")


def _in_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Deals the rows (key, members, node, tight, ...) of each key into blocks, the loose ones first, and
    gives each row to all pairs of blocks that have its own, but for two blocks of tight rows; adds low, high
    and block.  A tight row is copied once per block of loose ones."""
    counts = rows.groupBy(key).agg(F.first("members").alias("members"), F.sum(F.col("tight").cast("long")).alias("n_tight"), F.count_if(~F.col("tight")).alias("n_loose")).where("n_loose > 0")
    loose, all_ = F.ceil(F.col("n_loose") / block).cast("int"), F.ceil(F.col("n_loose") / block).cast("int") + F.ceil(F.col("n_tight") / block).cast("int")
    number = F.when(F.col("tight"), all_ - loose).otherwise(loose)
    own = F.pmod(F.xxhash64("node"), number).cast("int") + F.when(F.col("tight"), loose).otherwise(F.lit(0))
    others = F.sequence(F.lit(0), F.when(F.col("tight"), loose).otherwise(all_) - 1)
    dealt = _beside(rows, counts, key).where("n_loose is not null").withColumn("block", own).withColumn("other", F.explode(others))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def _one_block(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(0) for c in ("low", "high", "block")})


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "node")


def _band(sketch: str, k: Column) -> Column:
    return F.xxhash64(F.substring(sketch, k * (2 * ROWS) + 1, F.lit(2 * ROWS)), k)


def _candidate_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the texts (node, sketch) into candidate groups."""
    bands = texts.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("k"), "sketch").select("node", _band("sketch", F.col("k")).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1")
    crowded = cut(bands.join(sizes, "bucket"), "buckets")
    sketches = texts.select("node", "sketch")
    fields = ["bucket", "low", "high", "block", "node", "sketch"]
    rows = _one_block(crowded.where(F.col("members") <= BUCKET_BLOCK).join(sketches, "node")).select(*fields)
    large = crowded.where(F.col("members") > BUCKET_BLOCK)
    stars = None
    if _any(large):
        leaders = large.select("bucket", "members", "leader").distinct().join(sketches.toDF("leader", "leader_sketch"), "leader").drop("leader")
        met = _beside(large.join(sketches, "node"), leaders, "bucket").select("bucket", "members", "node", "leader", "sketch", "leader_sketch")
        met = cut(met.mapInArrow(_near_leader, "bucket long, members long, node long, leader long, sketch binary, tight boolean"), "led")
        stars = met.where("tight and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        rows = rows.union(_in_blocks(met, "bucket", BUCKET_BLOCK).select(*fields))
    pairs = _dealt(rows, "bucket").mapInArrow(_candidates, "a long, b long")
    return pairs.union(stars) if stars is not None else pairs


def _with_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, members, node, copies, sketch, text) with the text's shingles for the text."""
    for batch in batches:
        at = 0
        for _, offsets, value in shingles(batch.column(5)):
            n, flat = len(offsets) - 1, value.tobytes()
            made = pa.array([flat[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in range(5)), made], names=["cluster", "members", "node", "copies", "sketch", "shingles"])
            at += n


def _verified_links(sized: DataFrame, base: DataFrame) -> DataFrame:
    """(node, links, root): per text of a candidate group, parts of its number of links and of a
    spanning forest of them.  ``sized`` has the texts' first rows, ``base`` all documents."""
    sizes = sized.groupBy("cluster").agg(F.count("*").alias("members"))
    source = base.select(F.col("doc_id").alias("its_id"), F.xxhash64("text").alias("its_hash"), "text")
    text = sized.join(sizes, "cluster").join(source, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash")))
    plain = "cluster long, members long, node long, copies long, sketch binary, shingles binary"
    # A repeated row (id and text) joins once per repetition; one of each node does.
    shown = text.select("cluster", "members", "node", "copies", "sketch", "text").mapInArrow(_with_shingles, plain).dropDuplicates(["node"])
    fields = ["cluster", "low", "high", "block", "node", "copies", "sketch", "shingles"]
    if not _any(sizes.where(F.col("members") > GROUP_BLOCK)):
        return cut(_dealt(_one_block(shown).select(*fields), "cluster").mapInArrow(_verified, "node long, links long, root long"), "links")
    shown = cut(shown, "shingles")
    rows = _one_block(shown.where(F.col("members") <= GROUP_BLOCK)).select(*fields)
    large = shown.where(F.col("members") > GROUP_BLOCK)
    sample = large.where(F.pmod(F.xxhash64("node", F.lit(5)), F.floor(F.col("members") / CENTRE_SAMPLE)) == 0).select("cluster", "members", "shingles")
    centres = sample.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_centres, "cluster long, members long, centre binary")
    met = _beside(large, centres, "cluster").select("cluster", "members", "node", "copies", "sketch", "shingles", "centre")
    met = cut(met.mapInArrow(_near_centre, f"{plain}, tight boolean"), "centred")
    rows = rows.union(_in_blocks(met, "cluster", GROUP_BLOCK).select(*fields))
    verified = _dealt(rows, "cluster").mapInArrow(_verified, "node long, links long, root long")
    near = met.where("tight").select("cluster", "members", "node", "copies")
    facts = near.groupBy("cluster").agg(F.first("members").alias("members"), F.sum("copies").alias("all_copies"), F.min("node").alias("root"))
    sure = _beside(near, facts, "cluster").select("node", (F.col("all_copies") - F.col("copies")).alias("links"), "root")
    return cut(verified.union(sure), "links")


def rows_with_classes(docs: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, row_hash (of the text), node (null without
    words), root (equal within a class), copy_of (least id of its text) and n_links."""
    base = docs.select(F.col("doc_id").cast("long"), "text")
    sketched = cut(base.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").mapInArrow(_sketched, "doc_id long, row_hash long, node long, sketch binary"), "sketches")
    texts = cut(sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.min(F.struct("doc_id", "row_hash")).alias("first_row"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "texts")

    clusters = components(_candidate_links(texts))
    sized = cut(clusters.join(texts, "node").select("node", F.col("root").alias("cluster"), "copies", "sketch", F.col("first_row.doc_id").alias("id"), F.col("first_row.row_hash").alias("hash")), "members")
    verified = _verified_links(sized, base)

    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    facts = texts.select("node", "copy_of", "copies").join(counts, "node", "left").join(roots, "node", "left")
    facts = cut(facts.select("node", "copy_of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "facts")
    return sketched.select("doc_id", "row_hash", "node").join(facts, "node", "left").select("doc_id", "row_hash", "node", "root", "copy_of", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of all that links connect), n_links (other documents of a
    similarity of at least 0.8) and copy_of (least id of the same words) of each document."""
    rows = cut(rows_with_classes(docs), "rows")
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), "n_links", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least id stays, with
    all its columns; documents without words stay."""
    rows = cut(rows_with_classes(docs), "rows")
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("row"))
    stay = best.select("row.doc_id", "row.row_hash").union(rows.where("root is null").select("doc_id", "row_hash")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("doc")).select("doc", F.col("doc.doc_id").cast("long").alias("own_id"), F.xxhash64("doc.text").alias("own_hash"))
    kept = own.join(stay, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("row_hash")), "left_semi")
    # Of repeated rows with words one stays.
    turn = F.row_number().over(Window.partitionBy("own_id", "own_hash").orderBy("own_hash"))
    words_ = F.coalesce(F.col("doc.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.withColumn("turn", turn).where((F.col("turn") == 1) | ~words_).select("doc.*")
