"""Time rules over ISO-8601 strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 string with offset; NULL where it is none."""
    return F.unix_micros(F.try_to_timestamp(moment))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, never below zero; NULL where either end is missing."""
    elapsed = micros(end) - micros(start)
    return F.when(elapsed.isNotNull(), F.greatest(elapsed, F.lit(0).cast("long")) / F.lit(1_000_000.0))
