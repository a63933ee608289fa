"""Tracks: merging, segments, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(tracks: list[DataFrame], by: str | None = None) -> DataFrame:
    """All points of several tracks, one for each time: that of the earliest track in the list, then of the
    smallest position. Grouped minima, so no track has to fit a task."""
    tagged = [t.withColumn("source", F.lit(k)) for k, t in enumerate(tracks)]
    points = reduce(DataFrame.unionByName, tagged)
    keys = [k for k in (by, "t") if k]
    rest = [c for c in points.columns if c not in (*keys, "source")]
    first = points.groupBy(*keys).agg(F.min(F.struct("source", *rest)).alias("p"))
    return first.select(*keys, *(F.col(f"p.{c}").alias(c) for c in rest))


def segments(track: DataFrame, width_s: float = 3600.0) -> DataFrame:
    """Consecutive points a, b of each track_id with times in microseconds t; last: whether b is the end.

    Points are put in order within spans of width_s, and the last point of a span is carried over to the first
    of the next span that has one; so only the spans' first points, not the points, are ordered by whole tracks.
    """
    width, place = max(1, round(width_s * 1_000_000)), [c for c in ("lat", "lon", "depth") if c in track.columns]
    rows = track.groupBy("track_id", "t", F.floor(F.col("t") / width).alias("span")).agg(F.min(F.struct(*place)).alias("p"))
    heads = rows.groupBy("track_id", "span").agg(F.min(F.struct("t", "p")).alias("head"), F.max("t").alias("final"))
    by_span = Window.partitionBy("track_id").orderBy("span")
    final = F.max("final").over(by_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("track_id", "span", F.lead("head").over(by_span).alias("next"), final.alias("final"))
    inside = Window.partitionBy("track_id", "span").orderBy("t")
    rows = rows.withColumn("after", F.lead(F.struct("t", "p")).over(inside)).join(heads, ["track_id", "span"]).withColumn("b", F.coalesce("after", "next"))
    return rows.where("b IS NOT NULL").select("track_id", F.col("t").alias("ta"), F.col("b.t").alias("tb"), F.col("p").alias("a"), F.col("b.p").alias("b"), (F.col("b.t") == F.col("final")).alias("last"))


def summary(track: DataFrame) -> DataFrame:
    """Per track: points, points with depth, first and last time, median interval in seconds (null below two points)."""
    told = track.groupBy("track_id").agg(F.count("*").alias("points"), F.count("depth").alias("points_with_depth"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    gaps = segments(track).groupBy("track_id").agg(F.percentile((F.col("tb") - F.col("ta")) / 1_000_000, F.lit(0.5)).alias("median_interval_s"))
    return told.join(gaps, "track_id", "left")


def timed(points: DataFrame) -> DataFrame:
    """Points with a time; a depth that is no number is missing."""
    return points.where("t IS NOT NULL").withColumn("depth", F.nanvl("depth", F.lit(None).cast("double")))


def local_range(track: DataFrame, tz: str) -> DataFrame:
    """Per track the first and last time on the clocks of tz."""
    ends = track.groupBy("track_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.select("track_id", *(F.from_utc_timestamp(F.timestamp_micros(c), tz).cast("timestamp_ntz").alias(n) for c, n in (("a", "first_local"), ("b", "last_local"))))


def bounds(track: DataFrame) -> DataFrame:
    return track.groupBy("track_id").agg(F.min("t").alias("g0"), F.max("t").alias("g1"), F.count_distinct("t").alias("n"))
