"""Clocks: local camera time, UTC, frame times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, or of a naive one read as UTC (the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def local_to_utc(ts: Column, tz: str) -> Column:
    """A naive local time as naive UTC; the earlier instant where clocks go back."""
    return F.to_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")


def offset_text(local: Column, tz: str) -> Column:
    """+HH:MM of the zone at a naive local time."""
    s = (micros(local) - micros(local_to_utc(local, tz))) / 1_000_000
    minutes = F.abs(s / 60).cast("int")
    return F.concat(F.when(s < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def iso_with_offset(local: Column, tz: str) -> Column:
    return F.concat(F.date_format(local.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), offset_text(local, tz))


def frame_micros(start: Column, index: Column, interval_s: float, offset_s: float = 0.0) -> Column:
    """Time of frame number index of a recording that starts at start (microseconds)."""
    return start + F.lit(round(offset_s * 1_000_000)) + F.round(index * F.lit(float(interval_s)) * 1_000_000).cast("long")
