"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear density over training time 0 to 1.
The words a source shall give are its target; its documents lie one after the other, in the order
of a hash of their id and text, on the source's line of demanded words, and again from the start for a
second and third pass.  The integral of the schedule says which share of the target is demanded by
a time; its inverse turns a document's place on the line into a training position, and a range
sort by position gives the mixed order.

The place of a document needs a running total within its source.  It is summed in three steps, over
sections of hash buckets, over the buckets of a section and within each bucket of some thousands of rows, so a source with a third of all
rows is spread over many tasks.  Sources are a table too: their ranks come from a range sort in
two steps, their targets from a few rounds of sums, so there may be as many as there are web hosts.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources
of no words have target 0; repeated rows are separate documents, equal ones are interchangeable
(many equal rows, id and text, share a bucket); an
empty table gives an empty result; other columns are ignored, or carried along by ``training_order``.
A very long text costs the time of counting its words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.llm.common import cut, partitions

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
BUCKET_ROWS = 2000
#: Bits of a bucket's number within its section of buckets.
SECTION_BITS = 11
ORDER_SEED, TIE_SEED = 7, 11
KEY_BITS = 60

Knots = Sequence[tuple[float, float]]


def cyclic_weight(rank: int) -> float:
    """1, 2, 3, repeating."""
    return float(rank % 3 + 1)


def alternating_ramp(rank: int) -> Knots:
    """Even ranks are demanded more and more, odd ranks less and less."""
    return ((0.0, 0.5), (1.0, 1.5)) if rank % 2 == 0 else ((0.0, 1.5), (1.0, 0.5))


def water_level(sources: DataFrame, most: float = MOST_REPEATS) -> float:
    """The words per unit of weight at which sources (size, weight) share the total of all sizes, none
    giving more than ``most`` times its size: what those at their limit leave is shared by the others."""
    limit, level, closed = F.col("size") * most, 0.0, -1
    while True:
        full = F.col("weight") * level > limit if closed >= 0 else F.lit(False)
        row = sources.agg(F.sum("size").alias("all"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("heavy"), F.count_if(full).alias("full")).first()
        if row["full"] == closed or not row["heavy"]:
            return level
        closed, level = row["full"], (float(row["all"] or 0) - float(row["given"])) / row["heavy"]


def integrated(knots: Knots) -> list[tuple[float, float, float]]:
    """(time, density, demanded share by then) per knot, of a schedule scaled to the integral 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, share = [], 0.0
    for k, (t, w) in enumerate(knots):
        if k:
            t0, w0 = knots[k - 1]
            share += (t - t0) * (w0 + w) / 2 / area
        out.append((float(t), w / area, share))
    return out


def position(share: Column, knots: Column) -> Column:
    """The time by which ``share`` of the target is demanded; ``knots`` as of integrated()."""
    reached = F.filter(knots, lambda k: k["share"] <= share)
    a = F.element_at(reached, F.greatest(F.least(F.size(reached), F.size(knots) - 1), F.lit(1)))
    b = F.element_at(knots, F.greatest(F.least(F.size(reached), F.size(knots) - 1), F.lit(1)) + 1)
    width, rest = b["t"] - a["t"], F.greatest(share - a["share"], F.lit(0.0))
    slope = F.when(width > 0, (b["w"] - a["w"]) / width).otherwise(F.lit(0.0))
    # rest = w*x + slope*x*x/2, in the form that holds for slope 0 too
    root = a["w"] + F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(F.when(root > 0, a["t"] + 2 * rest / root).otherwise(b["t"]), b["t"])


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by the code points of ``source``, null last."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(partitions(sources.sparkSession), order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    begins = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.join(begins, "part").withColumn("rank", F.col("begin") + inside).drop("part", "begin")


def _demand(sized: DataFrame, weight: Callable[[int], float], schedule: Callable[[int], Knots], most: int) -> tuple[DataFrame, int]:
    """One row per source with its target and schedule, and the bits of hash buckets."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column(3).to_pylist()
            knots = [[dict(zip(("t", "w", "share"), k)) for k in integrated(schedule(r))] for r in ranks]
            kind = pa.list_(pa.struct([("t", pa.float64()), ("w", pa.float64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([float(weight(r)) for r in ranks], pa.float64()), pa.array(knots, kind)], names=["source", "size", "n", "weight", "knots"])

    facts = cut(ranked(sizes).select("source", "size", "n", "rank").mapInArrow(told, "source string, size long, n long, weight double, knots array<struct<t: double, w: double, share: double>>"), "demand")
    level = water_level(facts, most)
    rows = facts.agg(F.max("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    target = F.least(F.lit(level) * F.col("weight"), (F.col("size") * most).cast("double"))
    return facts.select(_home("source"), F.col("size").alias("source_size"), target.alias("target"), "knots"), bits


def _home(source: str) -> Column:
    """A source as a key that is never null: the source after a mark, or nothing."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("home")


def _taken(sized: DataFrame, rows: DataFrame, weight, schedule, most: int) -> DataFrame:
    """Adds source_size, target, passes, extra, taken and positions to ``rows``, which have the
    columns of ``sized`` (doc_id, source, size, key, tie) and maybe more."""
    known, bits = _demand(sized, weight, schedule, most)
    section_bits = max(0, bits - SECTION_BITS)
    top = lambda n: F.shiftright("key", KEY_BITS - n) if n else F.lit(0).cast("long")
    before = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda *keys, order: F.coalesce(F.sum("words").over(before(*keys, order=order)), F.lit(0))
    sums = cut(sized.groupBy(_home("source"), top(bits).alias("bucket"), top(section_bits).alias("section")).agg(F.sum("size").alias("words")), "buckets")
    sections = sums.groupBy("home", "section").agg(F.sum("words").alias("words")).select("home", "section", earlier("home", order="section").alias("section_begin"))
    buckets = sums.withColumn("bucket_begin", earlier("home", "section", order="bucket")).join(sections, ["home", "section"])
    # What is known of a source goes to its buckets, so that no join of rows is by source alone.
    begins = buckets.join(known, "home").select("home", "bucket", (F.col("section_begin") + F.col("bucket_begin")).alias("bucket_begin"), "source_size", "target", "knots")
    inside = Window.partitionBy("home", "bucket").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    # The join is on the window's own keys, so the rows are shuffled once for both.
    placed = (
        rows.withColumns({"home": _home("source"), "bucket": top(bits)})
        .withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(begins, ["home", "bucket"])
        .withColumn("begin", F.col("bucket_begin") + F.col("within"))
        .drop("home", "bucket", "within", "bucket_begin")
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")
    extra = F.least(F.greatest(rest - F.col("begin"), F.lit(0)), F.col("size"))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("extra") > 0).cast("long")).otherwise(F.lit(0))
    at = lambda p: (p * F.col("source_size") + F.col("begin") + F.col("size") / 2) / F.col("target")
    times = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda p: position(F.least(at(p), F.lit(1.0)), F.col("knots")))
    return (
        placed.withColumn("passes", passes)
        .withColumn("extra", extra.cast("long"))
        .withColumn("copies", copies.cast("int"))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
        .withColumn("positions", F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")))
    )


def order_key() -> Column:
    """A number of KEY_BITS bits by which a source's documents (doc_id, text) are ordered."""
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{ORDER_SEED}:"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, KEY_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Rows of one id but different texts have keys of their own; rows equal in all columns that
    # can be hashed are interchangeable.
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), order_key().alias("key"), F.xxhash64(*plain, F.lit(TIE_SEED)).alias("tie"), *more)


def mix(docs: DataFrame, weight: Callable[[int], float] = cyclic_weight, schedule: Callable[[int], Knots] = alternating_ramp, most: int = MOST_REPEATS) -> DataFrame:
    """Per document (doc_id, text, source): doc_id, source, size, source_size, target, taken and
    positions (one training position per pass that takes words of it), sorted by first position.

    ``weight`` and ``schedule`` take a source's rank by code points (null last).  The words of a
    source's last pass end exactly at its target, within a document maybe.
    """
    sized = cut(_sized(docs.select("doc_id", "text", "source")), "sizes")
    found = _taken(sized, sized, weight, schedule, most)
    first = F.try_element_at("positions", F.lit(1)).asc_nulls_last()
    return found.orderBy(first, "doc_id", "key", "tie").select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def training_order(docs: DataFrame, weight: Callable[[int], float] = cyclic_weight, schedule: Callable[[int], Knots] = alternating_ramp, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the documents, whole and with their own columns, once for every pass that
    takes them, in the order of training positions.  The document in which a source's last pass ends is taken
    if at least half of it lies before the target, so a source misses its target by half a document
    at most."""
    sized = cut(_sized(docs), "sizes")
    found = _taken(sized, _sized(docs, F.struct(*docs.columns).alias("doc")), weight, schedule, most)
    whole = F.when(F.col("copies") > F.col("passes"), F.col("passes") + (2 * F.col("extra") >= F.col("size")).cast("int")).otherwise(F.col("copies"))
    copies = found.withColumn("positions", F.slice("positions", F.lit(1), whole.cast("int"))).select("doc", "key", "tie", F.posexplode("positions").alias("turn", "position"))
    return copies.orderBy("position", "doc.doc_id", "turn", "key", "tie").select("doc.*")
