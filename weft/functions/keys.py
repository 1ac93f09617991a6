"""Column expressions that bring dirty keys and numbers to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters stripped from both ends of a key.
BLANKS = " \t\n\r\f\x0b\u00a0"


def stripped(c: Column) -> Column:
    """c without outer blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def canonical_key(c: Column) -> Column:
    """c without outer blanks, letter case and the zeros that pad its number; null if nothing is left."""
    low = F.lower(stripped(c))
    return F.when(low != "", F.regexp_replace(low, "^([^0-9]*)0+([0-9])", "$1$2"))


def whole_number(c: Column) -> Column:
    """The bigint that c spells, blanks and leading zeros aside; null for anything else."""
    return stripped(c).try_cast("bigint")


def decimal_text(c: Column) -> Column:
    """The double that c spells once blanks and thousands commas are removed; null for anything else."""
    bare = F.regexp_replace(c, "[\\s\u00a0,]", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def label(c: Column) -> Column:
    """c in lower case without outer blanks; null if nothing is left."""
    low = F.lower(stripped(c))
    return F.when(low != "", low)
