"""Text vectors: tokens, n-grams, FNV-1a buckets, TF-IDF weights, all in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of low to high words, joined by '_', shorter ones first."""

    def of(w: Column) -> Column:
        grams = []
        for n in range(low, high + 1):
            start = F.sequence(F.lit(1), F.size(w) - (n - 1))
            grams.append(F.when(F.size(w) >= n, _joined(w, start, n)).otherwise(F.array().cast("array<string>")))
        return F.concat(*grams)

    return bound(words, of)


def _joined(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), "_"))


def _step(h: Column, code: Column) -> Column:
    return (h.bitwiseXOR(code) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))


def _codes(term: Column) -> Column:
    return F.transform(F.split(term, ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(term: Column) -> Column:
    """FNV-1a over the term's code points (the terms here are ASCII)."""
    start = F.lit(FNV_OFFSET).cast("long")
    return F.when(F.length(term) == 0, start).otherwise(F.aggregate(_codes(term), start, _step))


def ngram_hashes(words: Column, low: int = 1, high: int = 2) -> Column:
    """FNV-1a of all n-grams of non-empty words, shorter ones first: an n-gram's hash goes on from that
    of the n-gram without its last word, so each word is read once per length."""
    none = F.array().cast("array<bigint>")

    def longer(codes: Column, shorter: Column, n: int) -> Column:
        joint = lambda h: _step(h, F.lit(ord("_")).cast("long"))
        go_on = lambda i: F.aggregate(F.get(codes, i + (n - 1)), joint(F.get(shorter, i)), _step)
        here = F.when(F.size(shorter) >= 2, F.transform(F.sequence(F.lit(0), F.size(shorter) - 2), go_on)).otherwise(none)
        return bound(here, lambda found: _from(codes, found, n))

    def _from(codes: Column, found: Column, n: int) -> Column:
        rest = longer(codes, found, n + 1) if n < high else none
        return F.concat(found, rest) if n >= low else rest

    single = lambda codes: F.transform(codes, lambda c: F.aggregate(c, F.lit(FNV_OFFSET).cast("long"), _step))
    return bound(F.transform(words, _codes), lambda codes: bound(single(codes), lambda found: _from(codes, found, 1)))


def bucket(term: Column, dim: int = 512, seed: int = 0) -> Column:
    return fnv1a(term).bitwiseXOR(F.lit(seed).cast("long")) % dim


def counted(buckets: Column) -> Column:
    """array<struct<bucket, tf>> of an array of buckets, ascending: sorted, then the lengths of runs."""

    def runs(x: Column) -> Column:
        head = lambda i: (i == 1) | (F.get(x, i - 1) != F.get(x, i - 2))
        heads = F.filter(F.sequence(F.lit(1), F.size(x)), head)
        ends = lambda h: F.transform(h, lambda i, k: F.struct(F.get(x, i - 1).alias("bucket"), (F.coalesce(F.get(h, k + 1), F.size(x) + 1) - i).cast("long").alias("tf")))
        return bound(heads, ends)

    none = F.array().cast("array<struct<bucket:bigint,tf:bigint>>")
    return bound(buckets, lambda x: F.when(F.size(x) > 0, bound(F.sort_array(x), runs)).otherwise(none))


def document_counts(docs: DataFrame, id: str, text: str, dim: int = 512, seed: int = 0, low: int = 1, high: int = 2) -> DataFrame:
    """(id, counts array<struct<bucket, tf>>) of each document, made within its row."""
    hashed = F.transform(ngram_hashes(tokens(F.col(text)), low, high), lambda h: h.bitwiseXOR(F.lit(seed).cast("long")) % dim)
    return docs.select(id, counted(hashed).alias("counts"))


def term_counts(docs: DataFrame, id: str, text: str, dim: int = 512, seed: int = 0, low: int = 1, high: int = 2) -> DataFrame:
    """(id, bucket, tf): how many terms of each document fall into each bucket; ids are unique, so
    nothing is shuffled."""
    return document_counts(docs, id, text, dim, seed, low, high).select(id, F.inline("counts"))


def idf(counts: DataFrame, n_docs: DataFrame, id: str, max_df: float = 1.0) -> DataFrame:
    """(bucket, df, idf): ln((n+1)/(df+1)) + 1, and 0 where more than max_df of the documents have
    the bucket.  ``counts`` has one row per (id, bucket); ``n_docs`` is a one-row table with the column n."""
    found = counts.groupBy("bucket").agg(F.count("*").alias("df"))
    n = F.lit(int(n_docs.first()["n"]))
    weight = F.log((n + 1) / (F.col("df") + 1)) + 1
    return found.select("bucket", "df", F.when(F.col("df") / n > max_df, F.lit(0.0)).otherwise(weight).alias("idf"))


def weighted(documents: DataFrame, weights: DataFrame, id: str, sublinear: bool = False) -> DataFrame:
    """(id, weights array<struct<bucket, weight>>) with unit length, from ``document_counts`` and
    ``idf``, without a shuffle of documents: the idf of at most dim buckets goes along as one array."""
    known = {int(r["bucket"]): float(r["idf"]) for r in weights.select("bucket", "idf").collect()}  # one row per bucket
    table = F.array(*(F.lit(known.get(k, 0.0)) for k in range(max(known, default=0) + 1)))
    tf = lambda c: 1 + F.log(c["tf"].cast("double")) if sublinear else c["tf"].cast("double")

    def unit(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        divided = lambda x, n: F.struct(x["bucket"].alias("bucket"), F.when(n > 0, x["w"] / n).otherwise(F.lit(0.0)).alias("weight"))
        return bound(length, lambda n: F.transform(raw, lambda x: divided(x, n)))

    raw = F.transform("counts", lambda c: F.struct(c["bucket"].alias("bucket"), (tf(c) * F.get(table, c["bucket"].cast("int"))).alias("w")))
    return documents.select(id, bound(raw, unit).alias("weights"))


def vectors(documents: DataFrame, weights: DataFrame, id: str, dim: int = 512, sublinear: bool = False) -> DataFrame:
    """(id, vector array<double>) of every document, zeros for those without terms; no shuffle."""
    made = weighted(documents, weights, id, sublinear)

    def spread(found: Column) -> Column:
        # The entries and a zero for every bucket, sorted: of each bucket the last counts.
        every = F.sort_array(F.concat(found, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.struct(k.cast("long").alias("bucket"), F.lit(float("-inf")).alias("weight")))))
        kept = lambda e: F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["bucket"] != x["bucket"], F.lit(True)))
        return F.transform(bound(every, kept), lambda x: F.when(x["weight"] > float("-inf"), x["weight"]).otherwise(0.0))

    return made.select(id, bound(F.col("weights"), spread).alias("vector"))


def tfidf(counts: DataFrame, weights: DataFrame, id: str, sublinear: bool = False) -> DataFrame:
    """(id, bucket, weight) with unit length per document; an all-zero document keeps its zeros."""
    tf = F.when(F.lit(sublinear), 1 + F.log(F.col("tf").cast("double"))).otherwise(F.col("tf").cast("double"))
    raw = counts.join(weights, "bucket").select(id, "bucket", (tf * F.col("idf")).alias("w"))
    length = raw.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, id).select(id, "bucket", F.when(F.col("length") > 0, F.col("w") / F.col("length")).otherwise(F.lit(0.0)).alias("weight"))


def dense(weights: DataFrame, docs: DataFrame, id: str, dim: int = 512) -> DataFrame:
    """(id, vector array<double>) of every document, zeros for those without terms."""
    entries = weights.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0.0)))
    return docs.select(id).join(entries, id, "left").select(id, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(full).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
