"""Cleaning of ids and keys, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def trimmed(c: Column | str) -> Column:
    """Without white space (Unicode) at either end; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def clean_id(c: Column | str) -> Column:
    """Trimmed, and null where nothing is left: a blank id identifies nothing."""
    return F.nullif(trimmed(c), F.lit(""))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)
