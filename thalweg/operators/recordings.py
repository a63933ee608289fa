"""Recordings: chapters, frames, overlap with a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import frame_micros
from ..functions.names import recording_key


def group_chapters(files: DataFrame) -> DataFrame:
    """files(parent, path, stem[, start_local, duration_s]) → a row per (parent, recording) with ordered chapters."""
    extra = [c for c in ("start_local", "duration_s") if c in files.columns]
    keyed = files.withColumn("k", recording_key(F.col("stem")))
    grouped = keyed.groupBy("parent", F.col("k.recording").alias("recording")).agg(F.array_sort(F.collect_list(F.struct(F.col("k.chapter").alias("chapter"), "path", *extra))).alias("chapters"))
    out = grouped.withColumn("n_chapters", F.size("chapters"))
    if "start_local" in extra:
        out = out.withColumn("start_local", F.get(F.col("chapters.start_local"), 0))
    if "duration_s" in extra:
        out = out.withColumn("duration_s", F.aggregate("chapters.duration_s", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))
    return out


def frames(recordings: DataFrame, interval_s: float = 1.0, offset_s: float = 0.0) -> DataFrame:
    """recordings(recording, start (microseconds), n_frames, ...) → a row per frame with index i and time t."""
    rows = recordings.where("start IS NOT NULL AND n_frames > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))
    return rows.withColumn("t", frame_micros(F.col("start"), F.col("i"), interval_s, offset_s))


def overlap_columns(v0: Column, v1: Column, g0: Column, g1: Column) -> dict[str, Column]:
    """pct_inside and note of a recording v0..v1 against a track g0..g1, all in microseconds."""
    inside = F.greatest(F.lit(0), F.least(v1, g1) - F.greatest(v0, g0))
    pct = F.when(v1 > v0, 100.0 * inside / (v1 - v0)).otherwise(0.0)
    hours = F.round(((v0 + v1) / 2 - (g0 + g1) / 2) / 3_600_000_000, 2)
    note = F.when(pct == 0, "none").when(pct < 90, "partial").otherwise("ok")
    return {"pct_inside": F.round(pct, 1), "note": note, "hours_off": F.when(pct == 0, hours)}


def overlap(recordings: DataFrame, g0: int, g1: int) -> DataFrame:
    """recordings(…, v0, v1) against one merged track's first and last time; no start: a problem row.

    The track's bounds are two numbers, so this is a projection and not a join.
    """
    cols = overlap_columns(F.col("v0"), F.col("v1"), F.lit(g0), F.lit(g1))
    known = F.col("v0").isNotNull()
    out = recordings.withColumn("problem", F.when(~known, "no start time"))
    for k, c in cols.items():
        out = out.withColumn(k, F.when(known, c))
    return out
