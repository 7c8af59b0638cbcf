"""Fellegi-Sunter arithmetic as column expressions.

u is the chance that unrelated cases agree on a value, m the chance that cases of one entity do.
All weights are in bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def m_of(u: Column, alpha: Column | float) -> Column:
    """m = (alpha u + 1) / (alpha + 1): from full repetition (alpha 0) to none (alpha large)."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (a * u + 1) / (a + 1)


def agreement_bits(m: Column, u: Column) -> Column:
    """log2(m/u); null unless u > 0."""
    return F.when(u > 0, F.log2(m / F.when(u > 0, u)))


def disagreement_bits(m: Column, u: Column) -> Column:
    """log2((1-m)/(1-u)); null unless both are below 1 and u above 0."""
    fine = (u > 0) & (u < 1) & (m < 1)
    return F.when(fine, F.log2((1 - m) / F.when(fine, 1 - u)))


def alpha_of(repeat_rate: float, reference_frequency: float) -> float:
    """The alpha with which a value of the reference frequency repeats at the given rate."""
    return (1 - repeat_rate) / (repeat_rate - reference_frequency)


def prior_bits(true_pairs: Column, all_pairs: Column) -> Column:
    """log2(t / (all - t)); null unless 0 < t < all."""
    fine = (true_pairs > 0) & (true_pairs < all_pairs)
    return F.when(fine, F.log2(true_pairs / F.when(fine, all_pairs - true_pairs)))


def bits_sort_key(bits: Column, partner: Column) -> Column:
    """A string that sorts ascending where bits sort descending: six digits, '#', the partner."""
    code = F.greatest(F.lit(0), F.least(F.lit(999999), 999999 - F.bround((bits + 100) * 1000).cast("int")))
    return F.concat(F.lpad(code.cast("string"), 6, "0"), F.lit("#"), partner.cast("string"))


def case_id(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of the parts, one after the other."""
    return F.substring(F.sha1(F.concat(*(p.cast("string") for p in parts))), 1, 16)


def year_quarter(cls: Column, at: Column) -> Column:
    """Secondary index key: class#YYYYQn."""
    return F.concat(cls, F.lit("#"), F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string"))
