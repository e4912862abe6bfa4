"""Times as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MICROS = 3_600_000_000


def whole_hours(start: Column | str, end: Column | str) -> Column:
    """Full hours from start to end, as a long; null if either is."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / HOUR_MICROS).cast("long")
