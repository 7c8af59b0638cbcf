"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Native: DataFrame functions only.  Paragraphs are what line feeds separate, long ones further cut
after sentence ends.  Each paragraph's SHA-256 gives a vector: ``WIDE`` words of 32 bits, and
``LANES`` lanes of one bit (the first half of the digest).  A fingerprint is the sum of its
paragraphs' vectors, the words modulo 2**32 and the lanes modulo 2**16, after the number of paragraphs.  So the
order of paragraphs doesn't matter, equal texts have equal fingerprints, and a paragraph is inserted
or deleted by adding or subtracting its vector (``inserted``, ``deleted``).  The words tell multisets
apart; the lanes tell how much they share.

As bits are fair coins, twice a lane less the number of paragraphs is a sum of signs, and the dot
product of two such vectors estimates how many paragraphs two documents share.  Likeness is twice
that over the sum of both squared lengths: 1 for equal fingerprints, near 0 (within about 0.09) for
documents without a common paragraph.  It is a function of the two fingerprints as published; the
sums of signs are read from the lanes' residues, which is exact up to 65,535 paragraphs, and beyond
that unless few paragraphs make up most of the text.  The hash isn't meant to withstand an adversary.

Defined results: a null text counts as empty, which is one empty paragraph; a null id comes last in
descending order; of repeated ids the order is by a hash of the text, then the text; a table of one
row is its own next document; an empty table gives an empty result; other columns are ignored.  A
very long text takes memory for its paragraphs, about 100 bytes each, and time in proportion.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fslink.llm.common import partitions

PARAGRAPH = r"\n|(?<=[.!?])\x20"
WIDE = 8
LANES = 128
#: Two lanes share a 64-bit sum, 32 bits each; a text has fewer than 2**31 paragraphs.
PAIR = 0x0000000100000001
LOW = 0xFFFFFFFF
MODULUS = 0x0000FFFF
#: Ranges of ids: so many per shuffle partition, or one per so many rows if that is more.
RANGES = 4
RANGE_ROWS = 200_000
#: Rows per range of which the bounds are chosen, about.
RANGE_SAMPLE = 20
#: Bounds that are searched one by one.
STEP = 64


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH, -1)


def hashed(parts: Column) -> Column:
    """The paragraphs' digests, each an array of WIDE words of 32 bits."""
    digests = F.transform(parts, lambda u: F.sha2(u, 256))
    word = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
    return F.transform(digests, lambda d: F.array(*(word(d, k) for k in range(WIDE))))


def summed(words: Column) -> Column:
    """array<long>: the sums of the words, then the pair sums of the lanes (lanes s of the words
    0 and 1, then of 2 and 3) of paragraphs' words."""
    zero = F.lit(0).cast("long")
    # Two words as one number, so that a step adds two lanes.
    joined = lambda k: F.transform(words, lambda w: F.shiftleft(w[2 * k], 32).bitwiseOR(w[2 * k + 1]))
    lane = lambda x, s: F.aggregate(x, zero, lambda a, v: a + F.shiftrightunsigned(v, s).bitwiseAND(F.lit(PAIR)))
    word = lambda k: F.aggregate(words, zero, lambda a, w: a + w[k])
    lanes = F.flatten(F.transform(F.array(joined(0), joined(1)), lambda x: F.array(*(lane(x, s) for s in range(32)))))
    wide = F.array(*(word(k) for k in range(WIDE)))
    return F.concat(wide, lanes)


def fingerprint(number: Column, sums: Column) -> Column:
    """Hexadecimal text: the number of paragraphs, the words modulo 2**32, the lanes modulo 2**16."""
    packed = lambda x: F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(MODULUS << 16)).bitwiseOR(x.bitwiseAND(F.lit(MODULUS)))
    each = F.transform(sums, lambda x, i: F.when(i < WIDE, x.bitwiseAND(F.lit(LOW))).otherwise(packed(x)))
    return F.concat(F.lpad(F.hex(number.bitwiseAND(F.lit(LOW))), 8, "0"), F.array_join(F.transform(each, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def inserted(sums: Column, more: Column) -> Column:
    """The sums after the paragraphs summed in ``more`` are inserted."""
    return F.zip_with(sums, more, lambda a, b: a + b)


def deleted(sums: Column, less: Column) -> Column:
    """The sums after the paragraphs summed in ``less``, which must be there, are deleted."""
    return F.zip_with(sums, less, lambda a, b: a - b)


def signs(number: Column, sums: Column) -> Column:
    """array<double>: for each lane the sum of its paragraphs' signs, from its residue."""
    pairs = F.slice(sums, WIDE + 1, LANES // 2)
    lanes = F.concat(F.transform(pairs, lambda x: x.bitwiseAND(F.lit(MODULUS))), F.transform(pairs, lambda x: F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(MODULUS))))
    around = 2 * (MODULUS + 1)
    return F.transform(lanes, lambda c: (F.pmod(2 * c - number + MODULUS + 1, F.lit(around)) - (MODULUS + 1)).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of sign sums: 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    both = dot(a, a) + dot(b, b)
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / both)))


def with_vector(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>n`` (paragraphs) and ``<prefix>v`` (sums) of a text column."""
    # Names are bound in a lambda, so that each step is evaluated once.
    made = F.transform(F.array(paragraphs(F.col(text))), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.element_at(F.transform(F.array(hashed(p)), summed), 1).alias("v")))
    return df.withColumn(f"{prefix}_made", F.element_at(made, 1)).select(*df.columns, F.col(f"{prefix}_made.n").alias(f"{prefix}n"), F.col(f"{prefix}_made.v").alias(f"{prefix}v"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds n_paragraphs and fingerprint to documents (doc_id, text): doc_id and these."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    made = with_vector(rows, "text", "p")
    return made.select("doc_id", F.col("pn").alias("n_paragraphs"), fingerprint(F.col("pn"), F.col("pv")).alias("fingerprint"))


def _key(doc_id: Column, text: Column) -> Column:
    """Struct that sorts as descending doc_id, null last, then a hash of the text."""
    return F.struct(doc_id.isNull().cast("int").alias("z"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))


def range_starts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Sorted keys of the first rows of ranges of rows (doc_id, text) that hold about as many each: of a sample by hash
    that has so many rows per range, every so many-th, and the least key of all.  They grow with the
    number of ranges, not of rows."""
    n = rows.count()
    ranges = max(RANGES * partitions(rows.sparkSession), math.ceil(n / RANGE_ROWS))
    every = max(1, n // (ranges * RANGE_SAMPLE))
    keyed = rows.select(_key(F.col("doc_id"), F.col("text")).alias("key"))
    sampled = F.when(F.pmod(F.xxhash64("key.i", "key.h"), F.lit(every)) == 0, F.col("key"))
    got = keyed.agg(F.min("key").alias("least"), F.collect_set(sampled).alias("some")).first()
    if got["least"] is None:
        return []
    some = sorted(map(tuple, got["some"]))
    return sorted({tuple(got["least"]), *(some[math.ceil(k * len(some) / ranges)] for k in range(1, ranges) if k * len(some) / ranges <= len(some) - 1)})


def _range(key: Column, starts: list[tuple[int, int, int]]) -> Column:
    """The number of the range of a key, found in three steps, and its first key, as a struct."""
    chunked = lambda xs: [xs[i : i + STEP] for i in range(0, len(xs), STEP)]
    told = [{"z": z, "i": i, "h": h} for z, i, h in starts]
    tree = chunked(chunked(told))
    kind = "struct<z:int,i:long,h:long>"
    table = lambda value, depth: F.from_json(F.lit(json.dumps(value)), "array<" * depth + kind + ">" * depth)
    last = lambda firsts: F.size(F.filter(firsts, lambda b: b <= key)) - 1
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    leaf = lambda a, b, xs: bound(last(xs), lambda c: F.struct(((a * STEP + b) * STEP + c).alias("at"), F.get(xs, c).alias("first")))
    middle = lambda a: bound(last(F.get(table([[x[0] for x in top] for top in tree], 2), a)), lambda b: bound(F.get(F.get(table(tree, 3), a), b), lambda xs: leaf(a, b, xs)))
    return bound(last(table([top[0][0] for top in tree], 1)), middle)


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next``, a struct of the carried columns of the row that follows in descending order of
    doc_id (ties by a hash of the text), after the last of the first.

    Rows are dealt into ranges of that order, so equal ids are split too.  A range's first row is also the one that
    follows the range before it, so it goes there too, as a guest.
    """
    starts = range_starts(rows.select("doc_id", "text"))
    if not starts:
        return rows.withColumn("next", F.struct(*carried))
    keyed = rows.withColumn("key", _key(F.col("doc_id"), F.col("text"))).withColumn("own", _range(F.col("key"), starts))
    place = lambda at, guest: F.struct(at.cast("int").alias("at"), guest.alias("guest"))
    at = F.col("own.at")
    before = place(F.pmod(at - 1, F.lit(len(starts))), F.when(at == 0, 2).otherwise(1))
    places = F.when(F.col("key") == F.col("own.first"), F.array(place(at, F.lit(0)), before)).otherwise(F.array(place(at, F.lit(0))))
    dealt = keyed.withColumn("placed", F.explode(places)).select(*rows.columns, "key", "placed.at", "placed.guest")
    # The first of all, a guest of the last range, comes at its end.
    order = Window.partitionBy("at").orderBy(F.col("guest") == 2, "key", "text")
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("guest = 0").select(*rows.columns, "next")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints each document (doc_id, text) and its edited text: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(with_vector(rows, "text", "t"), ["text", "tn", "tv"])
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next.text", F.lit(1), half))
    both = with_vector(linked.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "tn", "tv", F.col("next.tn").alias("nn"), F.col("next.tv").alias("nv")), "edited", "e")
    signed = both.select("*", *(signs(F.col(f"{x}n"), F.col(f"{x}v")).alias(f"{x}s") for x in "ten"))
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tn"), F.col("tv")).alias("fingerprint"),
        fingerprint(F.col("en"), F.col("ev")).alias("edited_fingerprint"),
        likeness(F.col("ts"), F.col("es")).alias("near_edited"),
        likeness(F.col("ts"), F.col("ns")).alias("near_next"),
    )
