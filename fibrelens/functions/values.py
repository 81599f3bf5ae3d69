"""Forgiving casts, ratios and display text, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
RUPEE = "₹"


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def to_long(value: Column) -> Column:
    """Whole number out of any text or number, cut towards zero; NULL when there is none."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def safe_long(value: Column) -> Column:
    return F.coalesce(to_long(value), F.lit(0).cast("bigint"))


def safe_double(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def not_nan(number: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(number), number)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when the whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def json_text(parsed: Column, name: str) -> Column:
    """A field of a parsed JSON object (variant) as text: numbers, flags and nested values as JSON text;
    NULL if the object lacks it, it is null, or nothing could be parsed."""
    return F.try_variant_get(parsed, f"$.{name}", "string")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_dash(text: Column) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(DASH))


def fixed(number: Column, decimals: int) -> Column:
    """Plain text with a fixed number of decimals, ties to even, no grouping."""
    return F.replace(F.format_number(number, decimals), F.lit(","), F.lit(""))


def money(amount: Column, decimals: int = 0) -> Column:
    return F.concat(F.lit(RUPEE), F.format_number(or_zero(amount), decimals))


def whole_percent(pct: Column) -> Column:
    """'63%', or a dash when there is no ratio."""
    return F.coalesce(F.concat(fixed(pct, 0), F.lit("%")), F.lit(DASH))
