"""A survey from recordings and tracks to geotagged frames and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, names
from ..operators import asof, recordings, reports, track

MANAGED = ("frames", "frames_csv", "frames_geojson", "report", "overlap")


def start_micros(recs: DataFrame, tz: str) -> DataFrame:
    return recs.withColumn("start_utc", clock.micros(clock.local_to_utc(F.col("start_local"), tz)))


def inspect(files: DataFrame, tracks: list[DataFrame] | None = None, tz: str = "Asia/Manila", clock_offset_s: float = 0.0) -> dict[str, DataFrame | None]:
    """recordings, track summary and overlap of files(parent, path, stem, start_local, duration_s)."""
    recs = start_micros(recordings.group_chapters(files), tz)
    shown = recs.select("parent", "recording", "n_chapters", "start_local", F.round(F.col("duration_s") / 60, 1).alias("duration_min"))
    if not tracks:
        return {"recordings": shown, "track": None, "overlap": None}
    merged = track.merge(tracks).withColumn("track_id", F.lit("merged"))
    ends = merged.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends.a is None:
        raise ValueError("the tracks have no points")
    v0 = F.col("start_utc") + F.lit(round(clock_offset_s * 1e6))
    timed = recs.withColumn("v0", v0).withColumn("v1", v0 + F.round(F.col("duration_s") * 1_000_000).cast("long"))
    over = recordings.overlap(timed, ends.a, ends.b).select("parent", "recording", "problem", "pct_inside", "note", "hours_off")
    return {"recordings": shown, "track": track.summary(merged), "overlap": over}


def process(
    files: DataFrame, tracks: list[DataFrame], interval_s: float = 1.0, tz: str = "Asia/Manila", clock_offset_s: float = 0.0, max_gap_s: float = 60.0, keep_untagged: bool = True, only: list[str] | None = None
) -> DataFrame:
    """A row per frame: frame_id, name, local and UTC time, position, depth, status.

    Recordings without a start time are an error, raised before anything is written.
    """
    recs = only_recordings(start_micros(recordings.group_chapters(files), tz), only)
    unset = [r.recording for r in recs.where("start_local IS NULL").select("recording").limit(20).collect()]
    if unset:
        raise ValueError(f"recordings without a start time: {', '.join(unset)}")
    n = F.greatest(F.lit(0), F.ceil(F.col("duration_s") / interval_s))
    local = clock.micros(F.col("start_local"))
    rows = recordings.frames(recs.withColumn("start", F.col("start_utc")).withColumn("n_frames", n), interval_s, clock_offset_s)
    rows = rows.withColumn("t_local", local + F.col("t") - F.col("start"))
    rows = rows.withColumn("frame_id", F.concat_ws("/", "parent", "recording", F.col("i").cast("string"))).withColumn("name", names.frame_name(F.col("t_local"), interval_s))
    rows = rows.withColumn("frame_filename", names.without_collisions(F.col("name"), F.col("recording"), "parent", "recording", "i"))
    probes = rows.select("frame_id", "frame_filename", "parent", "recording", "t_local", "t").withColumn("track_id", F.lit("merged"))
    merged = track.merge(tracks).withColumn("track_id", F.lit("merged"))
    tagged = asof.interpolate(probes, merged, max_gap_s)
    stamp = F.timestamp_micros("t_local").cast("timestamp_ntz")
    out = tagged.select(
        "frame_id", "frame_filename", "parent", "recording", clock.iso_with_offset(stamp, tz).alias("frame_datetime"), F.timestamp_micros("t").alias("ts_utc"),
        F.round("lat", 7).alias("latitude"), F.round("lon", 7).alias("longitude"), F.round("depth", 2).alias("depth_m"), "status",
    )
    folder = F.when(F.col("status") == "ok", "geotagged").otherwise("untagged" if keep_untagged else "")
    return out.withColumn("path", F.when(folder != "", F.concat(folder, F.lit("/"), "frame_filename")).otherwise(""))


def only_recordings(recs: DataFrame, only: list[str] | None) -> DataFrame:
    """The recordings named, all without names."""
    return recs.where(F.col("recording").isin(only)) if only else recs


def check_output(inputs: str, output: str) -> None:
    """The output must not be the input folder or inside it."""
    a, b = inputs.rstrip("/") + "/", output.rstrip("/") + "/"
    if b.startswith(a):
        raise ValueError(f"the output {output} is inside the input {inputs}")


def write(frames: DataFrame, output: str, settings: dict | None = None) -> None:
    """Frames as Parquet and CSV, features as GeoJSON lines, one report row; only these folders are replaced."""
    frames.write.mode("overwrite").parquet(f"{output}/frames")
    kept = frames.sparkSession.read.parquet(f"{output}/frames")
    kept.write.mode("overwrite").option("header", "true").csv(f"{output}/frames_csv")
    reports.geojson_features(kept.drop("ts_utc")).write.mode("overwrite").text(f"{output}/frames_geojson")
    report(kept, settings).write.mode("overwrite").json(f"{output}/report")


def report(frames: DataFrame, settings: dict | None = None) -> DataFrame:
    """One row: frames in all, counts by status, ok frames per recording, settings."""
    status = reports.status_counts(frames).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"))
    per = frames.groupBy("parent", "recording").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count("*").alias("n"))
    per = per.agg(F.array_sort(F.collect_list(F.struct("parent", "recording", "n_ok", "n"))).alias("recordings"))
    one = F.lit(1).alias("one")
    return status.select("*", one).join(per.select("*", one), "one").drop("one").withColumn("settings", F.lit(json.dumps(settings or {}, sort_keys=True)))
