"""Recorded cases as source-native feeds: the inverse of ``normalise``.

A feed's configuration gives column names, order, formats and the tag delimiter, the vocabulary its
native labels.  What was recorded stands in rec_<field> (null: blank), tags joined by ';' (empty:
none observed), and ``timed`` says whether the window was written with times of day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fslink.operators.generate import uniform
from fslink.operators.normalise import DERIVED, NONE_OBSERVED, TEXT_COLUMN, Feed, Vocabulary, lookup, spark_pattern

VERBATIM = ("fir_no", "district", "police_station")


def native_label(value: Column, name: str, code: str, vocabulary: Vocabulary) -> Column:
    """A canonical value's label in a feed (or, as 'en', its clause); a value without one raises."""
    return lookup(value, {v: labels[code] for v, labels in vocabulary.fields.get(name, {}).items() if code in labels}, what=f"value of {name}")


def native_cell(value: Column, name: str, feed: Feed, vocabulary: Vocabulary) -> Column:
    """The cell of a recorded field: its label, tags joined by the feed's delimiter, '' for a blank."""
    if name in vocabulary.tags:
        labels = F.transform(F.split(value, ";"), lambda t: native_label(t, name, feed.code, vocabulary))
        shown = F.when(value == "", native_label(F.lit(NONE_OBSERVED), name, feed.code, vocabulary)).otherwise(F.array_join(labels, feed.delimiter or ";"))
    else:
        shown = native_label(value, name, feed.code, vocabulary)
    return F.coalesce(shown, F.lit(""))


def told(fields: list[str], vocabulary: Vocabulary, omits: float = 0.0, reveals: float = 0.0, seed: int = 7) -> Column:
    """The clauses of a case as an array, in an order drawn per case.  A recorded field is left out
    with chance ``omits``; a blank one is told from the true value with chance ``reveals``."""
    parts = []
    for name in fields:
        has = F.col(f"rec_{name}").isNotNull()
        value = F.when(has & (uniform(seed, f"omit:{name}", "case_id") >= omits), F.col(f"rec_{name}")).when(~has & (uniform(seed, f"reveal:{name}", "case_id") < reveals), F.col(name))
        if name in vocabulary.tags:
            value_list = F.when(value == "", F.array(F.lit(NONE_OBSERVED))).otherwise(F.split(value, ";"))
        else:
            value_list = F.when(value.isNotNull(), F.array(value))
        clauses = F.transform(value_list, lambda v: native_label(v, name, "en", vocabulary))  # noqa: B023
        parts.append(F.when(value.isNotNull(), F.struct(uniform(seed, f"place:{name}", "case_id").alias("at"), clauses.alias("said"))))
    ordered = F.array_sort(F.array_compact(F.array(*parts)))
    return F.flatten(F.transform(ordered, lambda x: x["said"]))


def listed(clauses: Column) -> Column:
    """a, b and c."""
    n = F.size(clauses)
    return F.when(n < 2, F.array_join(clauses, "")).otherwise(F.concat(F.array_join(F.slice(clauses, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(clauses, -1)))


def native(cases: DataFrame, feed: Feed, vocabulary: Vocabulary, omits: float = 0.0, reveals: float = 0.0, asides: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """One feed's rows, in its columns and their order, of the cases of its place.

    Classes without a label in the feed still come, under their canonical name: to the normaliser
    they are out of scope.  ``asides`` are sentences about nothing scored; each case gets one.
    """
    mine = cases.where(F.col("state_code") == feed.code)
    cls = F.col("rec_crime_type") if "rec_crime_type" in cases.columns else F.col("crime_type")
    fields = [f for f in vocabulary.every if f"rec_{f}" in cases.columns]
    timed = F.col("timed") if "timed" in cases.columns else F.lit(True)
    full, day = spark_pattern(feed.date_format), spark_pattern(feed.date_only_format)
    when = lambda c: F.when(timed, F.date_format(c, full)).otherwise(F.date_format(c, day))
    spoken = F.coalesce(lookup(cls, {c: labels["en"] for c, labels in vocabulary.classes.items() if "en" in labels}, strict=False), cls)
    story = told(fields, vocabulary, omits, reveals, seed)
    opening = F.concat(F.lit("A "), spoken, F.lit(" was reported in "), F.coalesce("district", F.lit("an unnamed place")), F.lit("."))
    aside = F.get(F.array(*map(F.lit, asides)), F.floor(uniform(seed, "aside", "case_id") * len(asides)).cast("int")) if asides else F.lit(None).cast("string")
    out = []
    for canonical, name in feed.columns.items():
        if canonical == "crime_type":
            made = F.coalesce(lookup(cls, {c: labels[feed.code] for c, labels in vocabulary.classes.items() if feed.code in labels}, strict=False), cls)
        elif canonical in ("occurred_from", "occurred_to"):
            made = when(canonical)
        elif canonical == "registered_at":
            made = F.date_format(canonical, full)
        elif canonical == "narrative":
            made = F.concat_ws(" ", opening, F.when(F.size(story) > 0, F.concat(F.lit("It is stated that the accused "), listed(story), F.lit("."))), aside)
        elif canonical == TEXT_COLUMN:
            plain = told(fields, vocabulary, seed=seed)
            made = F.when(F.size(plain) > 0, F.concat(F.lit("Accused "), F.array_join(plain, "; "), F.lit("."))).otherwise("")
        elif canonical in VERBATIM or canonical not in vocabulary.every or canonical == DERIVED:
            made = F.coalesce(F.col(canonical).cast("string"), F.lit("")) if canonical in cases.columns else F.lit("")
        else:
            made = native_cell(F.col(f"rec_{canonical}"), canonical, feed, vocabulary) if canonical in fields else F.lit("")
        out.append(made.alias(name))
    return mine.select(*out)
