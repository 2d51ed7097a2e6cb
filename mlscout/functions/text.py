"""Scalar text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cell that starts with one of these runs as a spreadsheet formula.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]

# Characters and their HTML entities, in the order they are replaced.
HTML_ENTITIES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
]


def neutralise_formula(value: Column) -> Column:
    """Prefix a quote to text a spreadsheet would run; NULL and '' stay as they are."""
    return F.when(
        F.substring(value, 1, 1).isin(FORMULA_STARTS), F.concat(F.lit("'"), value)
    ).otherwise(value)


def html_escape(value: Column) -> Column:
    escaped = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in HTML_ENTITIES:
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def pseudonymise(value: Column) -> Column:
    """First 8 hex digits of SHA-256; NULL and '' become 'unknown'."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit("unknown")).otherwise(
        F.substring(F.sha2(text, 256), 1, 8)
    )


def number_text(value: Column, digits: int) -> Column:
    """Rounded number without trailing zeros: 80.0 -> '80', 66.6667 -> '66.7'."""
    fixed = F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))
    if digits == 0:
        return F.when(value.isNotNull(), fixed)
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return F.when(value.isNotNull(), trimmed)
