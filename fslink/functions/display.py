"""How evidence is shown: bits with a sign, values in words, names of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the literal marks of no evidence are shown as.
SHOWN = {"__MISSING__": "missing", "__ABSENT__": "absent", "__UNKNOWABLE__": "unknowable"}
MINUS, NOTHING, NO_BITS = "−", "–", "—"


def bits_text(bits: Column) -> Column:
    """'+1.56 bits', '−0.19 bits', '0.00 bits'; a dash for null."""
    sign = F.when(bits > 0, "+").when(bits < 0, MINUS).otherwise("")
    return F.when(bits.isNull(), NO_BITS).otherwise(F.concat(sign, F.format_string("%.2f bits", F.abs(bits))))


def value_text(value: Column) -> Column:
    """A recorded value as it is, a mark in words, a dash for null."""
    out = value
    for mark, word in SHOWN.items():
        out = F.when(value == mark, word).otherwise(out)
    return F.coalesce(out, F.lit(NOTHING))


def tags_text(tags: Column) -> Column:
    """Tags with commas, 'none' for none, a dash for null."""
    return F.when(tags.isNull(), NOTHING).when(F.size(tags) == 0, "none").otherwise(F.array_join(tags, ", "))


def field_text(name: Column) -> Column:
    """'entry point', or 'tools: crowbar' for a tag of a field."""
    base, tag = F.split_part(name, F.lit(":"), F.lit(1)), F.split_part(name, F.lit(":"), F.lit(2))
    label = F.replace(base, F.lit("_"), F.lit(" "))
    return F.when(tag != "", F.concat_ws(": ", label, tag)).otherwise(label)


def day_text(at: Column) -> Column:
    """'03 Feb 2021'; a dash for null."""
    return F.coalesce(F.date_format(at, "dd MMM yyyy"), F.lit(NOTHING))
