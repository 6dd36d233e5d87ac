"""Columns that bring identifiers, digests and times of the source tables into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around a value.
BLANKS = " \t"
#: What stands in a manifest where an identifier is missing, in lower case.
STAND_INS = ("na", "n/a", "unknown", "-")


def trimmed(column: Column) -> Column:
    """The value without surrounding blanks and tabs; null stays null."""
    return F.btrim(column.cast("string"), F.lit(BLANKS))


def identifier(column: Column) -> Column:
    """The identifier in lower case without surrounding blanks; null if it is null, empty or blank."""
    value = F.lower(trimmed(column))
    return F.when(value != "", value)


def linking_identifier(column: Column) -> Column:
    """``identifier``, and null for the stand-ins of a missing one."""
    value = identifier(column)
    return F.when(~value.isin(*STAND_INS), value)


def digest(column: Column) -> Column:
    """A digest in lower case without blanks and algorithm prefix; null if nothing is left."""
    value = F.lower(trimmed(column))
    bare = F.btrim(F.regexp_replace(value, r"^[a-z0-9_-]+\s*[:=]\s*", ""), F.lit(BLANKS))
    return F.when(bare != "", bare)


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(column.cast("timestamp"))
