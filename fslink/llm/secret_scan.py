"""Secret scans: fixed patterns, and a randomness test battery for anything that looks random.

Native: DataFrame functions only.  The patterns' matches get their places from the text between
them: ``split`` by the pattern gives the pieces, ``regexp_extract_all`` the matches, and running
sums of lengths give code-point offsets.  Running sums go block by block, so the time is in
proportion to the text and its matches.

Candidates of the battery are runs of at least ``LEAST`` characters of the base64 alphabets with a
digit and a letter, or with four capitals and four small letters.  Their encoding is inferred
(hexadecimal, base 32, lower-case or mixed
alphanumeric, letters, base 64), each character becomes its code in that alphabet, and three tests ask
whether the codes could be uniformly random: chi-squared over the alphabet, runs above and below
its middle, and the correlation of neighbours.  Fisher's method combines their p-values.  Over all
candidates of the table, a Benjamini-Hochberg procedure decides which are structured.  What its
false-discovery rate bounds is the share of random strings among those let go, not the share of
structured ones among those reported.  Candidates shorter than
the mean weigh less, in proportion to length (they tell less); none weighs more than 1, so a random
string of any length is let go with a chance of the limit at most.  The rest are spans of kind
``random``.  Not candidates, so never reported by the battery: runs of digits only, and of letters
in one case only.

The procedure needs the number of candidates below each p-value; that is a histogram of at most
``P_BINS`` rows, however large the table.

Defined results: a null text counts as empty and has no span; repeated rows give the same spans; an
empty table gives an empty result; other columns of any name are carried along or ignored.  A very
long text takes time and memory in proportion to its characters and matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# The base patterns (letters of the keywords in either case) and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A run that is long enough is found at its start by either form; shorter runs never match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

LEAST = 20
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])"
    r"|(?=(?:[0-9a-z+/_=-]*[A-Z]){4})(?=(?:[0-9A-Z+/_=-]*[a-z]){4}))[A-Za-z0-9+/_=-]{20,}"
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern of the whole candidate, its alphabet in code order), first match wins.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^[A-Z2-7]+=*$", UPPER + DIGITS[2:8]),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z_=-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"", UPPER + LOWER + DIGITS + "+/"),
)
RATE = 0.05
P_BINS = 401
BINS_A_DECADE = 20
REDACTED = "[redacted]"
#: Elements per block of a running total; characters per chunk of a text that is cut up.
BLOCK = 64
CHUNK = 4096


@dataclass(frozen=True)
class Cut:
    """Candidates of a weighted p-value up to ``limit`` are structured; lengths below
    ``mean_length`` are weighed against it."""

    limit: float = 0.0
    mean_length: float = 1.0


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, op: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each of the integers what ``op`` makes of 0 and all before it; block by block, so that
    no step copies more than a block."""
    blank = F.array().cast("array<int>")
    step = lambda a, x: F.struct(op(a["t"], x).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out"))
    small = lambda v, first: F.aggregate(v, F.struct(first.alias("t"), blank.alias("out")), step, lambda a: a["out"])
    whole = lambda v: F.aggregate(v, F.lit(0), op)

    def level(v: Column, depth: int) -> Column:
        if depth == 1:
            return small(v, F.lit(0))
        cuts = F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1)
        in_blocks = lambda blocks: bound(level(F.transform(blocks, whole), depth - 1), lambda first: F.flatten(F.zip_with(blocks, first, small)))
        return F.when(F.size(v) <= BLOCK, small(v, F.lit(0))).otherwise(bound(F.transform(cuts, lambda k: F.slice(v, k * BLOCK + 1, BLOCK)), in_blocks))

    return bound(values, lambda v: level(v, levels))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array of struct<s, k, e> of the pattern's matches in the text, and ``v``, what ``group`` caught."""
    token = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    caught = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def placed(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        moved = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, t: g + F.length(t))
        item = lambda t, i, start: F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.length(t)).alias("e"), (F.get(x["caught"], i) if group else t).alias("v"))
        return bound(running(moved, lambda a, b: a + b), lambda before: F.transform(found, lambda t, i: item(t, i, F.get(before, i) + F.get(gaps, i))))

    # Most texts have no match; they aren't split.
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    parts = lambda found: F.struct(found.alias("found"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"), *([caught.alias("caught")] if group else []))
    return bound(token, lambda found: F.when(F.size(found) > 0, bound(parts(found), placed)).otherwise(none))


def _tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z (Page's approximation, within 0.0002)."""
    return bound(F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0)), lambda z: 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)))


def p_value(token: Column) -> Column:
    """Fisher's combination of the three tests that ``token`` is uniformly random in its encoding."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in ENCODINGS[-2::-1]:
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    plain = F.rtrim(token, F.lit("="))
    item = F.struct(plain.alias("t"), alphabet.alias("a"))
    coded = F.transform(F.array(item), lambda x: F.struct(x["t"].alias("t"), x["a"].alias("a"), F.transform(F.split(x["t"], ""), lambda c: F.instr(x["a"], c) - 1).alias("x")))

    def battery(x: Column) -> Column:
        t, a, codes = x["t"], x["a"], x["x"]
        n, m = F.length(t).cast("double"), F.length(a).cast("double")
        # Equal characters, sorted together: the groups' lengths are the counts.
        groups = F.regexp_extract_all(F.array_join(F.sort_array(F.split(t, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
        squares = F.aggregate(groups, F.lit(0.0), lambda s, g: s + F.pow(F.length(g).cast("double"), F.lit(2.0)))
        chi, free = m / n * squares - n, m - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        ahead = F.slice(codes, 2, F.greatest(F.length(t) - 1, F.lit(0)))
        behind = F.slice(codes, 1, F.greatest(F.length(t) - 1, F.lit(0)))
        half = (F.length(a) / 2).cast("int")
        # What isn't in the alphabet counts as low, as its code -1 does.
        sides = F.call_function("translate", t, F.concat(a, F.lit("+/_=-")), F.concat(F.repeat(F.lit("l"), half), F.repeat(F.lit("h"), half), F.lit("lllll")))
        turns = sum((F.length(sides) - F.length(F.replace(sides, F.lit(turn), F.lit("")))) / 2 for turn in ("lh", "hl"))
        z_runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (m - 1) / 2
        spread = (m * m - 1) / 12
        product = F.aggregate(F.zip_with(behind, ahead, lambda u, v: (u - middle) * (v - middle)), F.lit(0.0), lambda s, v: s + v)
        z_serial = product / (spread * F.sqrt(n - 1))

        def fisher(z: Column) -> Column:
            two_sided = lambda x: F.least(F.lit(1.0), 2 * _tail(F.abs(x)))
            half = -sum(F.log(F.greatest(p, F.lit(1e-30))) for p in (_tail(z["chi"]), two_sided(z["runs"]), two_sided(z["serial"])))
            return bound(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        together = bound(F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial")), fisher)
        return F.when(n < LEAST / 2, F.lit(0.0)).otherwise(together)

    return F.element_at(F.transform(coded, battery), 1)


def _weighted(p: Column, length: Column, mean_length: float) -> Column:
    return p / F.least(F.lit(1.0), length.cast("double") / F.lit(float(mean_length)))


def structured_cut(docs: DataFrame, rate: float = RATE) -> Cut:
    """The weighted Benjamini-Hochberg cut over all candidates of the table (text)."""
    tokens = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0))).alias("token"))
    tested = tokens.select(F.length("token").alias("length"), p_value(F.col("token")).alias("p"))
    place = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * BINS_A_DECADE), F.lit(P_BINS - 1)).cast("int")
    # Length classes of 8 up to 512 characters keep the histogram bounded; all above are one class.
    size = F.least(F.floor(F.col("length") / 8), F.lit(64)).cast("int")
    rows = tested.groupBy(place.alias("bin"), size.alias("size")).agg(F.count("*").alias("n"), F.sum("length").alias("chars")).collect()
    m = sum(r["n"] for r in rows)
    if not m:
        return Cut()
    mean = sum(r["chars"] for r in rows) / m
    # The upper edge of each cell's weighted p-value, smallest first.
    cells = sorted((10 ** (-r["bin"] / BINS_A_DECADE) / min(1.0, r["chars"] / r["n"] / mean), r["n"]) for r in rows)
    limit = below = 0
    for edge, n in cells:
        below += n
        if edge <= rate * below / m:
            limit = edge
    return Cut(float(limit), float(mean))


def apart(base: Column, runs: Column) -> Column:
    """Those of the sorted, disjoint ``runs`` that overlap none of the sorted spans ``base``."""
    first_kind = F.lit(KINDS.index("random"))

    def chosen(merged: Column) -> Column:
        ends = F.transform(merged, lambda x: F.when(x["k"] < first_kind, x["e"]).otherwise(F.lit(0)))

        def free(ended: Column) -> Column:
            # A span that begins within a run comes right after it.
            after = lambda i: F.get(merged, i + 1)
            inside = lambda x, i: F.coalesce((after(i)["k"] < first_kind) & (after(i)["s"] < x["e"]), F.lit(False))
            return F.filter(merged, lambda x, i: (x["k"] == first_kind) & (F.get(ended, i) <= x["s"]) & ~inside(x, i))

        return bound(running(ends, _later), free)

    return F.when(F.size(runs) == 0, runs).otherwise(bound(F.sort_array(F.concat(base, runs)), chosen))


def spans(docs: DataFrame, decided: Cut) -> DataFrame:
    """doc, a struct of the document's columns, with ``base_spans`` and ``all_spans``, sorted arrays
    of struct<s start, k kind, e end>."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda x: F.length(x["v"]) >= ASSIGN_LEAST)
    base = F.sort_array(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    random = lambda x: _weighted(p_value(x["v"]), F.length(x["v"]), decided.mean_length) > decided.limit
    both = lambda x: bound(F.filter(apart(x["base"], x["run"]), random), lambda kept: F.struct(F.transform(x["base"], plain).alias("base"), F.transform(F.sort_array(F.concat(x["base"], kept)), plain).alias("all")))
    found = docs.select(F.struct(*docs.columns).alias("doc"))
    return found.select("doc", bound(F.struct(base.alias("base"), _spans(text, CANDIDATE, 3).alias("run")), both).alias("found")).select("doc", F.col("found.base").alias("base_spans"), F.col("found.all").alias("all_spans"))


def _listed(spans_: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each document."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = spans(rows, structured_cut(rows, rate)).select("doc.doc_id", "base_spans", "all_spans")
    number = lambda k: F.size(F.filter("all_spans", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans"), number(3).alias("n_random"))


def _between(text: Column, begins: Column, ends: Column) -> Column:
    """The pieces text[begin, end) of two arrays of places, from chunks of the text."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def piece(all_: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        part = lambda k, start, n: F.substr(F.get(all_, k), start + 1, n)
        head = part(first, a - first * CHUNK, F.lit(CHUNK))
        return (
            F.when(b <= a, F.lit(""))
            .when(first == last, part(first, a - first * CHUNK, b - a))
            .otherwise(F.concat(head, F.array_join(F.slice(all_, first + 2, last - first - 1), ""), part(last, F.lit(0), b - last * CHUNK)))
        )

    return bound(chunks, lambda all_: F.zip_with(begins, ends, lambda a, b: piece(all_, a, b)))


def without(text: Column, found: Column, mark: str) -> Column:
    """The text with the sorted spans ``found`` replaced by ``mark``, overlapping ones by one."""

    def rest(x: Column) -> Column:
        starts = F.transform(x["found"], lambda y: y["s"])
        ended = x["ended"]
        # A span begins a new gap's end if all before it have ended by then.
        fresh = F.filter(F.zip_with(ended, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda y: y["b"] >= y["a"])
        last = F.greatest(F.element_at(ended, -1), F.element_at(x["found"], -1)["e"])
        gaps = F.concat(fresh, F.array(F.struct(last.alias("a"), F.length(text).alias("b"))))
        return bound(gaps, lambda g: F.array_join(_between(text, F.transform(g, lambda y: y["a"]), F.transform(g, lambda y: y["b"])), mark))

    ended = running(F.transform(found, lambda y: y["e"]), _later)
    return bound(F.struct(found.alias("found"), ended.alias("ended")), rest)


def redacted(docs: DataFrame, rate: float = RATE, mark: str = REDACTED) -> DataFrame:
    """The documents with every span of their text replaced by ``mark``; n_chars, if there, follows."""
    found = spans(docs, structured_cut(docs, rate))
    some = F.size("all_spans") > 0
    made = found.select("doc", some.alias("some"), F.when(some, without(F.col("doc.text"), F.col("all_spans"), mark)).otherwise(F.col("doc.text")).alias("clean"))
    columns = []
    for field in docs.schema.fields:
        own = F.col("doc").getField(field.name)
        if field.name == "text":
            own = F.col("clean")
        elif field.name == "n_chars":
            own = F.when(F.col("some"), F.length("clean").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return made.select(*columns)
