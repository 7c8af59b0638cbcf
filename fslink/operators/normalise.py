"""Normalising source-native feeds into one case schema, driven by configuration.

A feed's configuration names its layout, formats, delimiter and columns; a vocabulary gives each
canonical value its native label per feed.  All columns are generated from them, so a new source is
a change of configuration.

No evidence has three kinds, kept in ``<field>__status``: missing (a blank cell), absent (the source
has no such column) and unknowable (a window too wide to place).  The value is null in all three;
status null means recorded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fslink.functions.evidence import case_id

MISSING, UNKNOWABLE, ABSENT = "__MISSING__", "__UNKNOWABLE__", "__ABSENT__"
NONE_OBSERVED = "none_observed"
STRUCTURED, FREE_TEXT = "structured", "free_text_mo"
TEXT_COLUMN = "mo_description"
DERIVED = "time_band"
#: strptime directives and what they are in Spark's datetime patterns.
DIRECTIVES = {"d": "dd", "m": "MM", "Y": "yyyy", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "y": "yy"}


def spark_pattern(strptime: str) -> str:
    """A strptime format as a Spark datetime pattern; literal letters are quoted."""
    out, word, k = "", "", 0

    def close() -> str:
        return f"'{word}'" if word else ""

    while k < len(strptime):
        c = strptime[k]
        if c == "%":
            out, word = out + close() + DIRECTIVES[strptime[k + 1]], ""
            k += 2
            continue
        if c.isalpha():
            word += c
        else:
            out, word = out + close() + c, ""
        k += 1
    return out + close()


@dataclass(frozen=True)
class Feed:
    """One source: its code, layout, formats and columns (canonical -> native name)."""

    code: str
    columns: dict[str, str]
    layout: str = STRUCTURED
    date_format: str = "%d/%m/%Y %H:%M"
    date_only_format: str = "%d/%m/%Y"
    delimiter: str | None = None
    absent: tuple[str, ...] = ()
    language: str = "en"


@dataclass(frozen=True)
class Vocabulary:
    """classes: class -> feed code (or 'en') -> label.  fields: field -> value -> code -> label."""

    classes: dict[str, dict[str, str]]
    fields: dict[str, dict[str, dict[str, str]]]
    family_of: dict[str, str]
    core: tuple[str, ...]
    ext: dict[str, tuple[str, ...]]
    tags: frozenset[str] = frozenset()
    bands: dict[str, tuple[int, int]] = field(default_factory=lambda: {"night": (22, 4), "early_morning": (4, 7), "day": (7, 22)})
    unknowable_above_hours: float = 12

    @property
    def every(self) -> tuple[str, ...]:
        return self.core + tuple(f for fields in self.ext.values() for f in fields)

    def labels(self, name: str, code: str) -> dict[str, str]:
        """native label -> canonical value of a field in a feed."""
        return {labels[code]: value for value, labels in self.fields.get(name, {}).items() if code in labels}

    def class_labels(self, code: str) -> dict[str, str]:
        return {labels[code]: cls for cls, labels in self.classes.items() if code in labels}

    def families_with(self, name: str) -> list[str] | None:
        return None if name in self.core else [family for family, fields in self.ext.items() if name in fields]


def lookup(raw: Column, labels: dict[str, str], strict: bool = True, what: str = "label") -> Column:
    """The canonical value of a native label.  An unknown one raises, or is null if not strict."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")
    found = F.try_element_at(known, raw)
    if strict:
        return F.when(raw.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), raw)).cast("string")).otherwise(found)
    return found


def blank(raw: Column) -> Column:
    return raw.isNull() | (raw == "")


def in_scope(rows: DataFrame, column: str, labels: dict[str, str], name: str = "crime_type") -> DataFrame:
    """Maps a native class; rows of a class that isn't known are dropped."""
    return rows.withColumn(name, lookup(F.col(column), labels, strict=False)).where(F.col(name).isNotNull())


def split_tags(raw: Column, delimiter: str | None, labels: dict[str, str], strict: bool = True) -> Column:
    """The canonical tags of a cell; null for a blank one, empty for the 'none observed' label."""
    tokens = F.split(raw, f"\\Q{delimiter}\\E", -1) if delimiter else F.array(raw)
    tags = F.transform(tokens, lambda t: lookup(t, labels, strict, "tag"))
    return F.when(blank(raw), F.lit(None)).otherwise(F.filter(tags, lambda t: t.isNotNull() & (t != NONE_OBSERVED)))


def band_of_hour(hour: Column, bands: dict[str, tuple[int, int]]) -> Column:
    """The band [start, end) of an hour; one with start after end goes over midnight."""
    out = F.lit(None).cast("string")
    for band, (a, b) in reversed(list(bands.items())):
        out = F.when((hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b), band).otherwise(out)
    return out


def time_band(begin: Column, end: Column, bands: dict[str, tuple[int, int]], unknowable_above_hours: float = 12) -> Column:
    """The band of a window's middle; UNKNOWABLE if the window is wider than so many hours."""
    a, b = F.unix_micros(begin.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    middle = F.hour(F.timestamp_micros(a + F.floor((b - a) / 2).cast("long")))
    return F.when(b - a > F.lit(int(unknowable_above_hours * 3_600_000_000)), UNKNOWABLE).otherwise(band_of_hour(middle, bands))


def window(raw_from: Column, raw_to: Column, feed: Feed) -> tuple[Column, Column, Column]:
    """Begin, end and whether both have a time of day: else both are read as dates."""
    full, day = spark_pattern(feed.date_format), spark_pattern(feed.date_only_format)
    a, b = F.try_to_timestamp(raw_from, F.lit(full)), F.try_to_timestamp(raw_to, F.lit(full))
    timed = a.isNotNull() & b.isNotNull()
    return F.when(timed, a).otherwise(F.try_to_timestamp(raw_from, F.lit(day))), F.when(timed, b).otherwise(F.try_to_timestamp(raw_to, F.lit(day))), timed


def extracted(text: Column, name: str, vocabulary: Vocabulary) -> Column:
    """Finds a field's clauses in text, lower-cased: the first value in vocabulary order for a
    categorical field, all tags for a tag field; null if there is none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = [(value, low.contains(phrase)) for value, labels in vocabulary.fields.get(name, {}).items() if (phrase := labels.get("en", "").lower())]
    there = F.length(low) > 0
    if name in vocabulary.tags:
        tags = F.array_compact(F.array(*(F.when(hit, F.lit(value)) for value, hit in said if value != NONE_OBSERVED)).cast("array<string>"))
        none = [hit for value, hit in said if value == NONE_OBSERVED]
        return F.when(there & (F.size(tags) > 0), tags).when(there & (none[0] if none else F.lit(False)), F.array().cast("array<string>"))
    return F.when(there, F.coalesce(*(F.when(hit, F.lit(value)) for value, hit in said), F.lit(None).cast("string")))


def validated(reply: Column, name: str, vocabulary: Vocabulary) -> Column:
    """A hosted extractor's JSON reply: the field if all its values are allowed, else null."""
    allowed = F.array(*(F.lit(v) for v in vocabulary.fields.get(name, {}) if v != NONE_OBSERVED)).cast("array<string>")
    if name in vocabulary.tags:
        got = F.from_json(F.get_json_object(reply, f"$.{name}"), "array<string>")
        return F.when(F.forall(got, lambda t: F.array_contains(allowed, t)), got)
    got = F.get_json_object(reply, f"$.{name}")
    return F.when(F.array_contains(allowed, got), got)


def normalise(rows: DataFrame, feed: Feed, vocabulary: Vocabulary, extract: bool = False, strict: bool = True) -> DataFrame:
    """One feed's rows as canonical cases: identity, window, every field with its status, text and
    provenance.  Rows of unknown classes are dropped.  ``extract`` fills the fields of a free-text
    feed from its description (or narrative)."""
    at = {canonical: F.col(f"`{native}`") for canonical, native in feed.columns.items() if native in rows.columns}
    kept = rows.withColumn("_class", lookup(at["crime_type"], vocabulary.class_labels(feed.code), strict=False)).where(F.col("_class").isNotNull())
    registered = F.to_timestamp(at["registered_at"], spark_pattern(feed.date_format))
    begin, end, timed = window(at["occurred_from"], at["occurred_to"], feed)
    family = F.lit(None).cast("string")
    for cls, name in vocabulary.family_of.items():
        family = F.when(F.col("_class") == cls, name).otherwise(family)
    narrative = F.coalesce(at.get("narrative", F.lit("")), F.lit(""))
    described = at.get(TEXT_COLUMN, F.lit(None).cast("string"))
    text = F.when(~blank(described), described).otherwise(narrative)
    base = kept.withColumns({"_family": family, "_from": begin, "_to": end, "_timed": timed, "_text": text})
    band = F.when(F.col("_timed"), time_band(F.col("_from"), F.col("_to"), vocabulary.bands, vocabulary.unknowable_above_hours)).otherwise(MISSING)
    values, statuses, said = [], [], []
    for name in vocabulary.every:
        kind = "array<string>" if name in vocabulary.tags else "string"
        nothing = F.lit(None).cast(kind)
        families = vocabulary.families_with(name)
        mine = F.lit(True) if families is None else F.col("_family").isin(*families)
        source = F.lit("source")
        if name == DERIVED:
            value, status = F.when(band.isin(MISSING, UNKNOWABLE), nothing).otherwise(band), F.when(band.isin(MISSING, UNKNOWABLE), band)
        elif feed.layout == FREE_TEXT:
            value = extracted(F.col("_text"), name, vocabulary) if extract else nothing
            status, source = F.when(value.isNull(), MISSING), F.lit("llm_extracted")
        elif name in feed.absent or name not in at:
            value, status = nothing, F.lit(ABSENT)
        elif name in vocabulary.tags:
            value, status = split_tags(at[name], feed.delimiter, vocabulary.labels(name, feed.code), strict), F.when(blank(at[name]), MISSING)
        else:
            value, status = F.when(~blank(at[name]), lookup(at[name], vocabulary.labels(name, feed.code), strict)), F.when(blank(at[name]), MISSING)
        values.append(F.when(mine, value).otherwise(nothing).alias(name))
        statuses.append(F.when(mine, status).alias(f"{name}__status"))
        said.append(F.when(mine, F.struct(F.lit(name).alias("key"), F.when(value.isNotNull(), source).alias("value"))))
    return base.select(
        case_id(F.lit(feed.code), at["fir_no"], F.year(registered)).alias("case_id"), F.lit(feed.code).alias("state_code"), at.get("district", F.lit(None).cast("string")).alias("district"), at["fir_no"].alias("fir_no"), F.col("_class").alias("crime_type"),
        F.col("_family").alias("family"), F.col("_from").alias("occurred_from"), F.col("_to").alias("occurred_to"), registered.alias("registered_at"), *values, *statuses,
        narrative.alias("narrative_text"), F.lit(feed.language).alias("narrative_lang"), F.map_from_entries(F.array_compact(F.array(*said))).alias("field_provenance"), F.lit(feed.layout == FREE_TEXT).alias("needs_enrichment"),
    )


def nested(cases: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The record for serving: structs mo_core and mo_ext (one per family), literal sentinels in
    string fields."""
    def shown(name: str) -> Column:
        return F.col(name).alias(name) if name in vocabulary.tags else F.coalesce(F.col(name), F.col(f"{name}__status")).alias(name)

    ext = [F.when(F.col("family") == family, F.struct(*map(shown, fields))).alias(f"mo_ext_{family}") for family, fields in vocabulary.ext.items()]
    return cases.select("case_id", "state_code", "district", "crime_type", "occurred_from", "occurred_to", "registered_at", F.struct(*map(shown, vocabulary.core)).alias("mo_core"), *ext, "narrative_text", "narrative_lang", "field_provenance")


def agreement(cases: DataFrame, truth: DataFrame, fields: list[str], least: float = 0.95) -> DataFrame:
    """(state_code, field, n, agreed, passed): normalised against true values (case_id, <field>),
    true nulls (not applicable) left out."""
    rows = cases.alias("c").join(truth.alias("t"), F.col("c.case_id") == F.col("t.case_id"))
    text = lambda x: F.array_join(x, ";") if x is None else x.cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text(F.col(f"c.{f}")).alias("got"), text(F.col(f"t.{f}")).alias("want")) for f in fields))).alias("x")
    long = rows.select("c.state_code", each).select("state_code", "x.*").where("want is not null")
    return long.groupBy("state_code", "field").agg(F.count("*").alias("n"), F.avg(F.col("got").eqNullSafe(F.col("want")).cast("double")).alias("agreed")).withColumn("passed", F.col("agreed") >= least)
