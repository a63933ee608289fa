"""Positions: interpolation, degrees-minutes-seconds, descriptions, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(r: Column, a: Column, b: Column) -> Column:
    """Linear from a to b; with one side missing the other side, unweighted."""
    return F.coalesce(a + r * (b - a), a, b)


def rounded(x: Column | str, places: int) -> Column:
    """Rounded in doubles, as databases do; Spark's own rounds the decimal text, which differs in the last place of large numbers."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * 10.0**places, 0) / 10.0**places


def dms(degrees: Column) -> Column:
    """array of (num, den): degrees, minutes, ten-thousandths of seconds, of the absolute value."""
    a = F.abs(degrees)
    d = F.floor(a)
    minute = (a - d) * 60
    m = F.floor(minute)
    s = F.bround((minute - m) * 60 * 10000).cast("long")
    one = F.lit(1).cast("long")
    return F.array(*(F.struct(n.cast("long").alias("num"), den.cast("long").alias("den")) for n, den in ((d, one), (m, one), (s, F.lit(10000)))))


def from_dms(parts: Column, negative: Column) -> Column:
    """Signed degrees of (num, den) triples."""
    total = sum((F.get(parts, k)["num"] / F.get(parts, k)["den"] / 60**k for k in range(3)), F.lit(0.0))
    return F.when(negative, -total).otherwise(total)


def position_error_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.round(F.greatest(F.abs(lat1 - lat2), F.abs(lon1 - lon2)) * 111_000, 2)


def description(depth: Column, note: Column | None = None, base: str = "benthic survey frame") -> Column:
    return F.concat_ws("; ", F.lit(base), F.when(depth.isNotNull(), F.format_string("echosounder depth %.2f m", depth)), note if note is not None else F.lit(None))


def with_class(text: Column, label: Column) -> Column:
    """The description with its class replaced or added."""
    return F.concat(F.get(F.split(text, "; benthic class "), 0), F.lit("; benthic class "), label)
