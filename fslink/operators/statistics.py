"""Checks of a corpus: marginals and drift, mutual information, dispersion, recording rates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fslink.functions.evidence import prior_bits
from fslink.sources.shared import freed, release, settle, shared_path

#: Of the shuffled tables: rows of a slice, rows times replicates at a time, values of a column that are broadcast.
SLICE_ROWS, NULL_ROWS, CODES = 200_000, 50_000_000, 100_000


def pair_stats(cases: DataFrame, entity: str, cls: str, place: str) -> DataFrame:
    """One row: pairs of one entity in all, of different classes, of different places, all pairs and
    the prior in bits (3 decimals).  Counted from group sizes."""
    known = cases.where(F.col(entity).isNotNull())
    pairs = lambda n: (n * (n - 1) / 2).cast("long")

    def same(*keys: str) -> DataFrame:
        return known.groupBy(entity, *keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("pairs_" + "_".join(keys) if keys else "pairs"))

    whole = cases.agg(pairs(F.count("*")).alias("all_pairs"))
    row = same().join(same(cls)).join(same(place)).join(whole)
    t = F.col("pairs")
    return row.select(t.alias("true_pairs"), (t - F.col(f"pairs_{cls}")).alias("cross_class"), (t - F.col(f"pairs_{place}")).alias("cross_place"), "all_pairs", F.round(prior_bits(t, F.col("all_pairs")), 3).alias("prior_bits"))


def mutual_information(cases: DataFrame, cls: str, x: str, y: str, least_rows: int = 50) -> DataFrame:
    """(class, n, mi_bits) of two categorical columns within each class of enough complete rows."""
    cells = cases.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(cls).alias("cls"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    return information(cells, least_rows)


def information(cells: DataFrame, least_rows: int, *keep: str) -> DataFrame:
    """(class, n, mi_bits) of counts (class, x, y, n), and per ``keep`` columns too."""
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keep, "cls", *keys))
    parts = cells.select(*keep, "cls", "n", over().alias("total"), over("x").alias("nx"), over("y").alias("ny")).where(F.col("total") >= least_rows)
    p = F.col("n") / F.col("total")
    return parts.groupBy(*keep, "cls").agg(F.max("total").alias("n"), F.sum(p * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi_bits"))


def permutation_null(cases: DataFrame, id: str, cls: str, x: str, y: str, times: int = 50, seed: int = 1) -> DataFrame:
    """(replicate, class, n, mi_bits) with y shuffled within its class by a seeded hash order."""
    return permuted_information(cases, id, cls, [(x, y)], times, seed).select("replicate", "cls", "n", "mi_bits")


def permuted_information(cases: DataFrame, id: str, cls: str, pairs: list[tuple[str, str]], times: int = 50, seed: int = 1, least_rows: int = 1) -> DataFrame:
    """(replicate, pair, class, n, mi_bits) of each pair of columns (by its place) with the second one shuffled
    within its class: of a class's complete rows, that which is k-th by the MD5 of seed:replicate:id gives y to the one
    which is k-th by id.

    A few replicates at a time: rows are packed as bytes (MD5 and codes) by class and slice of the MD5, each slice is
    sorted, and of it only the values stay, in their order.  They meet the values of x in the order of ids
    block by block of places.  No row is joined, no class is in one task, and one sort serves all pairs.
    """
    spark = cases.sparkSession
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    rows, known = cases.select(F.col(id).alias("id"), F.col(cls).alias("cls"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(columns))), []
    rows = rows if hasattr(cases, "settled_at") else settle(rows)
    counts = settle(rows.groupBy("cls", *(f"v{k}" for k in range(len(columns)))).agg(F.count("*").alias("n")))
    base, values = rows, []
    for k, name in enumerate(["cls", *(f"v{k}" for k in range(len(columns)))]):
        found = sorted(r["v"] for r in counts.select(F.col(name).alias("v")).distinct().where("v is not null").collect())
        # A class that is null has a code; a value that is null has the one after the last.
        codes = spark.createDataFrame([*((v, i) for i, v in enumerate(found)), *([(None, len(found))] if not k else [])], T.StructType([T.StructField("w", counts.schema[name].dataType), T.StructField(f"c{k}", T.IntegerType())]))
        known.append(codes)
        values.append(len(found))
        joined = lambda df: df.join(F.broadcast(codes) if len(found) <= CODES else codes, F.col(name).eqNullSafe(F.col("w")), "left").drop("w", name).withColumn(f"c{k}", F.coalesce(f"c{k}", F.lit(len(found))))  # noqa: B023, E731
        base, counts = joined(base), joined(counts) if not k else counts
    base = settle(base.select("id", F.concat_ws(":", F.lit(""), F.col("id").cast("string")).alias("tail"), F.col("c0").alias("g"), *(f"c{k + 1}" for k in range(len(columns)))))
    freed(spark)
    sizes = {r["g"]: r["n"] for r in counts.groupBy(F.col("c0").alias("g")).agg(F.sum("n").alias("n")).collect()}
    kept = _Kept(values[1:], [(columns.index(a), columns.index(b)) for a, b in pairs])
    path = shared_path(spark, "null")
    # By id: of each range of ids and each class the values of x.
    by_id = base.repartitionByRange(max(1, -(-sum(sizes.values()) // SLICE_ROWS)), F.col("g"), F.col("id").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    by_id = by_id.sortWithinPartitions(F.col("g"), F.col("id").asc_nulls_last()).drop("id", "tail")
    first = settle(by_id.mapInArrow(kept.in_order, f"b long, {PIECES}"))
    left = settle(_blocks(first, "g"))
    release(first)
    slices = {g: -(-n // SLICE_ROWS) for g, n in sizes.items()}
    step = max(1, NULL_ROWS // max(1, sum(sizes.values())))
    for begin in range(1, times + 1 if sizes else 1, step):
        packed = base.drop("id").mapInArrow(kept.packed(seed, range(begin, min(times + 1, begin + step)), slices), "replicate int, g int, b int, held binary")
        right = settle(packed.groupBy("replicate", "g", "b").applyInArrow(lambda keys, rows: kept.by_key(keys, rows), f"replicate int, b long, {PIECES}"))
        met = left.groupBy("g", "pair", "block").cogroup(_blocks(right, "replicate", "g").groupBy("g", "pair", "block")).applyInArrow(lambda keys, xs, ys: kept.met(keys, xs, ys), "replicate int, pair int, g int, x int, y int, n long")
        cells = met.groupBy("replicate", "pair", "g", "x", "y").agg(F.sum("n").alias("n"))
        cells.coalesce(8).write.mode("append").parquet(path)
        release(right)
        del packed, right, met, cells
        freed(spark)
    done = spark.read.schema("replicate int, pair int, g int, x int, y int, n long").parquet(path) if sizes and times else spark.createDataFrame([], "replicate int, pair int, g int, x int, y int, n long")
    release(left)
    release(base)
    cells = done.join(F.broadcast(known[0].select(F.col("c0").alias("g"), F.col("w").alias("cls"))), "g").drop("g")
    return information(cells, least_rows, "replicate", "pair")


#: A piece: values of one column, of complete rows of a pair, in their order.
PIECES = "g int, pair int, n long, codes binary"
#: Rows that are packed at a time, and hashed at a time.
PACKED_ROWS, HASHED_ROWS = 200_000, 8192


class _Kept:
    """How the values of rows are kept as bytes: each column's codes in 1, 2 or 4, that of null after the others."""

    def __init__(self, values: list[int], places: list[tuple[int, int]]):
        self.values, self.places = values, places
        self.types = [np.dtype("<u1" if n < 1 << 8 else "<u2" if n < 1 << 16 else "<u4") for n in values]
        self.ends = np.cumsum([0, *(t.itemsize for t in self.types)])

    def matrix(self, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Rows of bytes from the columns c1, c2, ..."""
        return np.concatenate([table[f"c{k + 1}"].to_numpy(zero_copy_only=False).astype(t).view(np.uint8).reshape(-1, t.itemsize) for k, t in enumerate(self.types)], axis=1)

    def pieces(self, held: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
        """(pair, n, codes) of one side of each pair's complete rows."""
        codes = [np.ascontiguousarray(held[:, a:b]).view(t).ravel() for a, b, t in zip(self.ends, self.ends[1:], self.types)]
        there, out = [c < n for c, n in zip(codes, self.values)], []
        for k, pair in enumerate(self.places):
            values = codes[pair[side]][there[pair[0]] & there[pair[1]]]
            out.append((k, len(values), values.tobytes()))
        return out

    def in_order(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range of sorted rows (g, c1, c2, ..., part): pieces of x by class and batch."""
        for k, batch in enumerate(batches):
            g = batch["g"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            found = [((int(batch["part"][0].as_py()) << 32) + k, int(g[a]), *piece) for a, b in zip(cuts, cuts[1:]) if b > a for piece in self.pieces(self.matrix(batch.slice(a, b - a)), 0)]
            if found:
                yield _batch(found, ["b", "g", "pair", "n", "codes"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])

    def packed(self, seed: int, replicates: range, slices: dict[int, int]):
        """Of rows (tail, g, c1, c2, ...), for each replicate: MD5 and codes by class and slice of the MD5."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, n = [], 0
            for batch in batches:
                some.append(batch)
                n += len(batch)
                if n >= PACKED_ROWS:
                    yield from self._packed(pa.Table.from_batches(some), seed, replicates, slices)
                    some, n = [], 0
            if n:
                yield from self._packed(pa.Table.from_batches(some), seed, replicates, slices)

        return run

    def _packed(self, table: pa.Table, seed: int, replicates: range, slices: dict[int, int]) -> Iterator[pa.RecordBatch]:
        g, codes, tails = table["g"].to_numpy(), self.matrix(table), _Tails(table["tail"])
        per = np.zeros(max(slices) + 1, np.uint64)
        per[list(slices)] = list(slices.values())
        begins = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        for replicate in replicates:
            held = np.concatenate([tails.md5(f"{seed}:{replicate}".encode()), codes], axis=1)
            high = np.ascontiguousarray(held[:, :4]).view(">u4").ravel().astype(np.uint64)
            at = begins[g] + (high * per[g] >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, held = at[order], held[order]
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                own = int(np.searchsorted(begins, at[a], "right")) - 1
                found.append((replicate, own, int(at[a] - begins[own]), held[a:b].tobytes()))
            yield _batch(found, ["replicate", "g", "b", "held"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def by_key(self, keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Pieces of y of a slice, by the MD5."""
        held = np.frombuffer(b"".join(table["held"].to_pylist()), np.uint8).reshape(-1, 16 + int(self.ends[-1]))
        high, low = (np.ascontiguousarray(held[:, a : a + 8]).view(">u8").ravel().astype(np.uint64) for a in (0, 8))
        order = np.argsort(high)
        high = high[order]
        if (high[1:] == high[:-1]).any():
            order = order[np.lexsort((low[order], high))]
        replicate, g, b = (k.as_py() for k in keys)
        found = [(replicate, b, g, *piece) for piece in self.pieces(held[order, 16:], 1)]
        return pa.Table.from_batches([_batch(found, ["replicate", "b", "g", "pair", "n", "codes"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()])])

    def met(self, keys: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of x and y in a block of places, for each replicate."""
        g, pair, _ = (k.as_py() for k in keys)
        a, b = (self.types[k] for k in self.places[pair])
        x, out = _joined(left).view(a).astype(np.int64), []
        for replicate in pc.unique(right["replicate"]).to_pylist():
            y = _joined(right.filter(pc.equal(right["replicate"], replicate))).view(b)
            cells, n = _counts(x, y)
            fixed = [pa.array(np.full(len(n), v, np.int32)) for v in (replicate, pair, g)]
            out.append(pa.table([*fixed, pa.array((cells >> 32).astype(np.int32)), pa.array((cells & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["replicate", "pair", "g", "x", "y", "n"]))
        return pa.concat_tables(out)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _joined(pieces: pa.Table) -> np.ndarray:
    """The bytes of a block's pieces by their places."""
    codes = pieces["codes"].to_pylist()
    return np.frombuffer(b"".join(codes[i] for i in np.argsort(pieces["at"].to_numpy(), kind="stable")), np.uint8)


def _blocks(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces in order of ``b`` cut at every ``SLICE_ROWS``-th place: with ``block`` and ``at``, the place of the first row."""
    before = Window.partitionBy(*keys, "pair").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    known = settle(pieces.select(*keys, "pair", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")))
    placed = pieces.where("n > 0").join(F.broadcast(known), [*keys, "pair", "b"])
    size = F.lit(SLICE_ROWS).cast("long")
    cut = placed.withColumn("width", F.length("codes") / F.col("n")).withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    low, high = F.greatest("at", F.col("block") * size), F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * size)
    codes = F.substring("codes", ((low - F.col("at")) * F.col("width") + 1).cast("int"), ((high - low) * F.col("width")).cast("int"))
    return cut.select(*keys, "pair", F.col("block").cast("long").alias("block"), low.cast("long").alias("at"), codes.alias("codes"))


class _Tails:
    """The ends of messages that are hashed behind one beginning after another."""

    def __init__(self, tails: pa.ChunkedArray):
        tails = pa.concat_arrays(tails.cast(pa.large_binary()).chunks)
        ends = np.frombuffer(tails.buffers()[1], np.int64)[tails.offset : tails.offset + len(tails) + 1]
        data = np.frombuffer(tails.buffers()[2] or b"", np.uint8)
        self.all, self.length = tails, np.diff(ends)
        self.most = int(self.length.max(initial=0))
        if self.most > 55:
            return
        # The byte that MD5 puts behind a message is there already.
        self.bytes = np.zeros((len(tails), self.most + 1), np.uint8)
        for k in range(self.most):
            there = np.flatnonzero(self.length > k)
            self.bytes[there, k] = data[ends[there] + k]
        self.bytes[np.arange(len(tails)), self.length] = 0x80

    def md5(self, begin: bytes) -> np.ndarray:
        """16 bytes of each message."""
        if len(begin) + self.most > 55:
            return np.frombuffer(b"".join(hashlib.md5(begin + t.as_py()).digest() for t in self.all), np.uint8).reshape(-1, 16)
        out, p = np.empty((len(self.length), 16), np.uint8), len(begin)
        for first in range(0, len(out), HASHED_ROWS):
            part = self.bytes[first : first + HASHED_ROWS]
            block = np.zeros((len(part), 64), np.uint8)
            block[:, :p] = np.frombuffer(begin, np.uint8)
            block[:, p : p + part.shape[1]] = part
            block.view("<u8")[:, 7] = (self.length[first : first + HASHED_ROWS] + p) * 8
            used = (p + part.shape[1] + 3) // 4
            out[first : first + HASHED_ROWS] = _md5(np.ascontiguousarray(block.view("<u4").T), {*range(used), 14})
        return out


MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5(words: np.ndarray, used: set[int]) -> np.ndarray:
    """The MD5 of messages of one block each, given as 16 rows of words of which all but ``used`` are zero."""
    start = [np.full(words.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(MD5_SINES[i])
        if k in used:
            f += words[k]
        np.left_shift(f, np.uint32(MD5_SHIFTS[i]), out=t)
        f >>= np.uint32(32 - MD5_SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + y for x, y in zip((a, b, c, d), start)], axis=1).astype("<u4").view(np.uint8)


def _counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int(y.max(initial=0)) + 1
    if (int(x.max(initial=0)) + 1) * width > 1 << 20:
        return np.unique((x << 32) | y, return_counts=True)
    n = np.bincount(x * width + y)
    there = np.flatnonzero(n)
    return ((there // width) << 32) | (there % width), n[there]


def z_score(observed: Column, expected: Column, n: Column) -> Column:
    """|observed - expected| in standard errors; infinite where an impossible or certain value
    differs."""
    spread = F.sqrt(expected * (1 - expected) / n)
    return F.when(spread > 0, F.abs(observed - expected) / F.when(spread > 0, spread)).when(observed == expected, 0.0).otherwise(F.lit(float("inf")))


def realised(cases: DataFrame, cls: str, column: str, expected: DataFrame) -> DataFrame:
    """(class, value, n, observed, expected, drift, z) of a categorical column against expected
    shares (cls, value, p)."""
    total = cases.where(F.col(column).isNotNull()).groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("total"))
    counts = cases.groupBy(F.col(cls).alias("cls"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    rows = expected.join(total, "cls").join(counts, ["cls", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    observed = F.col("n") / F.col("total")
    return rows.select("cls", "value", "n", observed.alias("observed"), F.col("p").alias("expected"), F.when(F.col("p") > 0, observed / F.col("p") - 1).alias("drift"), z_score(observed, F.col("p"), F.col("total")).alias("z"))


def largest_drift(found: DataFrame, top: int = 15, least_p: float = 0.02) -> DataFrame:
    """The ``top`` values of the largest relative drift, rare and certain ones left out."""
    return found.where((F.col("expected") >= least_p) & (F.col("expected") < 1)).orderBy(F.abs("drift").desc(), "cls", "value").limit(top)


def first_per(cases: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return cases.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def dispersion(cases: DataFrame, entity: str, least: int = 2) -> DataFrame:
    """One row: entities of at least ``least`` cases, variance over mean of what exceeds that, and the
    share of pairs that the largest tenth of them holds."""
    size = cases.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # Ranks come from counts per size, which are few, not from one ordering of all entities.
    per = size.groupBy("n").agg(F.count("*").alias("k"))
    order = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0))).crossJoin(per.agg(F.sum("k").alias("entities")))
    tenth = F.greatest(F.floor(F.col("entities") / 10), F.lit(1))
    top = F.greatest(F.lit(0), F.least(F.col("k"), tenth - F.col("before")))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    moments = size.agg((F.var_samp(F.col("n") - least) / F.avg(F.col("n") - least)).alias("index"))
    return ranked.agg(F.max("entities").alias("entities"), (F.sum(top * pairs) / F.sum(F.col("k") * pairs)).alias("top_tenth_share")).crossJoin(moments).select("entities", "index", "top_tenth_share")


def recording_rates(rows: DataFrame, place: str, true: dict[str, str]) -> DataFrame:
    """(place, field, n, recorded, confused) per field: the share with a recorded value, and of these
    the share that differs from the truth.  ``true`` maps recorded to true columns."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("field"), F.col(r).cast("string").alias("said"), F.col(t).cast("string").alias("was")) for r, t in true.items()))).alias("c")
    long = rows.select(F.col(place).alias("place"), each).select("place", "c.*").where("was is not null")
    there = F.col("said").isNotNull()
    return long.groupBy("place", "field").agg(F.count("*").alias("n"), F.avg(there.cast("double")).alias("recorded"), F.avg(F.when(there, (F.col("said") != F.col("was")).cast("double"))).alias("confused"))


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the same keys up to this one, and
    ``<name>_all``, that over all rows of the keys.

    Rows are sorted by range over keys and order; sums within a range and of the ranges before are added, so a
    key with most of the rows is spread over many tasks.  ``order`` must tell the rows of a key apart.
    """
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(k).asc_nulls_first() for k in keys]
    placed = settle(rows.withColumns({f"_s_{n}": c for n, c in sums.items()}).repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    per = placed.groupBy("_part", *keys).agg(*(F.sum(f"_s_{n}").alias(f"_p_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    known = per.select("_part", *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_p_{n}").over(whole).alias(f"{n}_all") for n in sums))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({f"_r_{n}": F.sum(f"_s_{n}").over(inside) for n in sums})
    same = F.col("_part") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = run.join(known.withColumnRenamed("_part", "_q"), same)
    return joined.select(*rows.columns, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def serial_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str = "serial") -> DataFrame:
    """Numbers rows from 1 within each group, as registers do within a station and year."""
    return running(rows, keys, [F.col(c).asc_nulls_first() for c in order], {name: F.lit(1)}).drop(f"{name}_all")


def feed_positions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds position (from 0) and total within each group."""
    found = running(rows, keys, [F.col(c).asc_nulls_first() for c in order], {"position": F.lit(1)})
    return found.withColumn("position", F.col("position") - 1).withColumnRenamed("position_all", "total")


def cdf_draw(u: Column, chances: dict[str, float]) -> Column:
    """The first value whose cumulative chance lies above u, the last if none does."""
    total, out = sum(chances.values()), F.lit(list(chances)[-1])
    steps, run = [], 0.0
    for value, p in chances.items():
        run += p
        steps.append((run, value))
    for upto, value in reversed(steps[:-1]):
        out = F.when(u * total < upto, value).otherwise(out)
    return out


def corpus_counts(cases: DataFrame, entity: str, place: str, least: int = 2) -> DataFrame:
    """One row: cases, serial_entities (of at least so many cases), serial_cases, relocated_entities
    (serial ones of more than one place)."""
    per = cases.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"), F.count_distinct(place).alias("places"))
    serial = F.col("n") >= least
    counts = per.agg(F.count_if(serial).alias("serial_entities"), F.coalesce(F.sum(F.when(serial, F.col("n"))), F.lit(0)).alias("serial_cases"), F.count_if(serial & (F.col("places") > 1)).alias("relocated_entities"))
    return cases.agg(F.count("*").alias("cases")).join(counts)


def link_examples(links: DataFrame) -> DataFrame:
    """(example, case_id, partner_id): the strongest and the weakest link, and the first of each pair
    class by case and rank."""
    pair = F.struct("case_id", "partner_id")
    first = F.struct("case_id", "rank", "partner_id")
    at = lambda cls: F.min(F.when(F.col("pair_class") == cls, first))
    found = links.agg(
        F.min(F.struct((-F.col("total_bits")).alias("b"), pair.alias("p"))).getField("p").alias("top"),
        F.min(F.struct(F.col("total_bits").alias("b"), pair.alias("p"))).getField("p").alias("low"),
        at("same_type").alias("same"), at("cross_type").alias("cross"),
    )
    item = lambda name, c: F.struct(F.lit(name).alias("example"), F.col(c)["case_id"].alias("case_id"), F.col(c)["partner_id"].alias("partner_id"))
    rows = found.select(F.explode(F.array(item("strongest", "top"), item("weakest", "low"), item("same_type", "same"), item("cross_type", "cross"))).alias("r"))
    return rows.select("r.*").where("case_id is not null")


def unordered_pairs(rows: DataFrame, first: str) -> DataFrame:
    """One row per unordered pair (id_a, id_b): the one with the least ``first``."""
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    return rows.groupBy(low.alias("id_a"), high.alias("id_b")).agg(F.min(first).alias(first))


def relocated_entities(cases: DataFrame, id: str, entity: str, place: str, at: str) -> DataFrame:
    """(entity, first_case, second_case): for entities of more than one place, the first case of each
    of the first two places by time."""
    known = cases.where(F.col(entity).isNotNull())
    firsts = known.groupBy(F.col(entity).alias("entity"), F.col(place).alias("place")).agg(F.min(F.struct(F.col(at).alias("at"), F.col(id).alias("id"))).alias("first"))
    order = Window.partitionBy("entity").orderBy("first")
    two = firsts.withColumn("k", F.row_number().over(order)).where("k <= 2")
    return two.groupBy("entity").agg(F.max(F.when(F.col("k") == 1, F.col("first.id"))).alias("first_case"), F.max(F.when(F.col("k") == 2, F.col("first.id"))).alias("second_case")).where("second_case is not null")
