"""Time expressions. Timestamps are UTC; ages are taken against an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def age_s(ts: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return micros / F.lit(1e6)


def iso_ts(ts: Column) -> Column:
    """ISO-8601 UTC with milliseconds and a trailing Z."""
    return F.date_format(
        F.date_trunc("millisecond", ts.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )
