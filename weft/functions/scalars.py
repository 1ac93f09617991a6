"""Scalar expressions that differ from Spark's built-in ones of the same purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """The double that a text spells; blank text is 0, anything else null."""
    return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.trim(c).try_cast("double"))


def number_or_null(c: Column) -> Column:
    """The double that a text spells; blank and other text is null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def pad_start(c: Column, size: int, fill: str = " ") -> Column:
    """c as text, filled from the left to `size` characters; longer text stays whole."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(size), F.length(text)), F.lit(fill))


def text(*parts: Column | str) -> Column:
    """Values and text joined; null reads as `null`."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))


def piece(c: Column, separator: str, at: int) -> Column:
    """Part number `at` (from 0) of a text split at a literal separator; null beyond the end."""
    return F.try_element_at(F.split(c, r"\Q" + separator + r"\E"), F.lit(at + 1))


def now_ms() -> Column:
    """Milliseconds since 1970, once per query."""
    return F.unix_millis(F.current_timestamp())
