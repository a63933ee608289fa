"""The tools of the assistant: surveys, geotags, classes and documents, over folders of files.

Each returns plain values for a model to read; lists are bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cite
from ..operators import recordings, reports
from ..sources import adapters, exif, gpx, listings, media
from . import classify, outputs, survey
from .assistant import Tools
from .library import Library

TEXT, NUMBER, WHOLE, FLAG = ({"type": t} for t in ("string", "number", "integer", "boolean"))
MOST = 200


def rows(df: DataFrame, most: int = MOST) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class SurveyTools:
    """model: a function that loads a classifier on an executor, see adapters.predict, with its class names."""

    def __init__(self, spark: SparkSession, library: Library | None = None, model: Callable | None = None, class_names: list[str] | None = None, probe: Callable[[str], dict] = adapters.probe):
        self.spark, self.library, self.model, self.class_names, self.probe = spark, library, model, class_names or [], probe

    def files(self, videos_dir: str) -> DataFrame:
        found = listings.find_files(self.spark, videos_dir, listings.VIDEO).where("ext <> '.lrv'")
        if not found.limit(1).count():
            raise ValueError(f"no videos in {videos_dir}")
        return adapters.probed(found.select("parent", "path", "stem"), self.probe)

    def tracks(self, videos_dir: str, gpx_dir: str | None) -> list[DataFrame]:
        place = gpx_dir or videos_dir
        some = listings.find_files(self.spark, place, (".gpx",)).limit(1).count()
        return [gpx.read_gpx(self.spark, place).drop("track_id")] if some else []

    def list_folder(self, path: str, depth: int = 2) -> dict:
        """Counts of videos, tracks and pictures per folder."""
        base = path.rstrip("/")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"))
        return {"folders": rows(reports.folder_counts(found, depth, MOST))}

    def inspect_survey(self, videos_dir: str, gpx_dir: str | None = None, tz: str = "Asia/Manila", clock_offset_s: float = 0.0) -> dict:
        """Recordings, the track and how they overlap; writes nothing."""
        seen = survey.inspect(self.files(videos_dir), self.tracks(videos_dir, gpx_dir), tz, clock_offset_s)
        return {k: rows(v) if v is not None else None for k, v in seen.items()}

    def process_survey(
        self, videos_dir: str, output_dir: str, gpx_dir: str | None = None, interval_s: float = 1.0, tz: str = "Asia/Manila", clock_offset_s: float = 0.0, max_gap_s: float = 60.0, recordings: list[str] | None = None, classify: bool | None = None
    ) -> dict:
        """Geotagged frames as tables; classes too if a model is set. A failed classification leaves the geotags."""
        if classify and not self.model:
            return {"error": "no model is set to classify with"}
        survey.check_output(videos_dir, output_dir)
        tracks = self.tracks(videos_dir, gpx_dir)
        if not tracks:
            return {"error": f"no tracks in {gpx_dir or videos_dir}"}
        frames = survey.process(self.files(videos_dir), tracks, interval_s, tz, clock_offset_s, max_gap_s, only=recordings)
        outputs.clear(self.spark, output_dir)
        survey.write(frames, output_dir, {"interval_s": interval_s, "tz": tz, "clock_offset_s": clock_offset_s, "max_gap_s": max_gap_s})
        said = json.loads(self.spark.read.text(f"{output_dir}/report").first().value)
        if self.model and classify is not False:
            try:
                said["classification"] = self.classify_frames(output_dir)
            except Exception as e:  # the geotags are written
                said["classification"] = {"error": f"{type(e).__name__}: {e}"}
        return said

    def verify_geotags(self, output_dir: str, n: int = 5) -> dict:
        """Positions in the pictures' EXIF against the frame table, for n frames spread over it."""
        ok = self.spark.read.parquet(f"{output_dir}/frames").where("status = 'ok'")
        sample = reports.systematic_sample(ok.withColumn("at", F.unix_micros("ts_utc")), "at", n).withColumn("file", F.concat(F.lit(output_dir.rstrip("/") + "/"), "path"))
        if not (wanted := [r.file for r in sample.select("file").collect()]):
            return {"error": "no geotagged frames"}
        there = listings.find_files(self.spark, output_dir, (".jpg",)).select("path").withColumn("file", F.regexp_replace("path", "^file:/*", "/")).where(F.col("file").isin(wanted))
        paths = [r.path for r in there.collect()]
        tags = self.spark.createDataFrame([], "file string, lat double, lon double")
        if paths:
            read = exif.read_tags(self.spark.read.format("binaryFile").load(paths).select("path", "content"))
            tags = read.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "lat", "lon")
        checks = rows(reports.verified(sample, tags, "file").select("frame_filename", "has_gps", "max_error_m"))
        return {"checked": len(checks), "all_have_gps": all(c["has_gps"] for c in checks), "samples": checks}

    def concatenate_recordings(self, videos_dir: str, output_dir: str) -> dict:
        """Recordings of several chapters as one file each."""
        survey.check_output(videos_dir, output_dir)
        found = listings.find_files(self.spark, videos_dir, listings.VIDEO).where("ext <> '.lrv'")
        plan = adapters.concat_manifest(recordings.group_chapters(found.select("parent", "path", "stem")))
        made = media.each_recording(plan.where("action = 'concatenate'"), media.concat_command, output_dir, "_concat.mp4")
        return {"concatenated": rows(made), "single_chapter_recordings_skipped": [r.recording for r in plan.where("action = 'skip'").limit(MOST).collect()]}

    def classify_frames(self, output_dir: str, conf: float = 0.0, smooth_s: float = 0.0) -> dict:
        """Classes for the geotagged frames of a processed survey."""
        if not self.model:
            return {"error": "no model is set to classify with"}
        frames = self.spark.read.parquet(f"{output_dir}/frames")
        pictures = frames.where("status = 'ok'").select("frame_id", F.concat(F.lit(output_dir.rstrip("/") + "/"), "path").alias("path"))
        found = classify.classify_frames(frames, adapters.predict(pictures, self.model), self.class_names, conf, smooth_s)
        return outputs.write_classified(found, output_dir)

    def search_documents(self, query: str, k: int = 5) -> dict:
        """Excerpts of the indexed documents."""
        if self.library is None:
            return {"error": "no documents are indexed"}
        none = F.lit(None).cast("int")
        hits = self.library.retrieve(query, k).withColumn("cite", cite(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("cell"), none, none))
        return {"excerpts": rows(hits.select("cite", "name", F.substring("text", 1, 2500).alias("text")), k)}


def survey_tools(own: SurveyTools) -> Tools:
    """The seven tools and the search with their schemas."""
    tools = Tools()
    folder = {"videos_dir": TEXT, "gpx_dir": TEXT, "tz": TEXT, "clock_offset_s": NUMBER}
    more = {"output_dir": TEXT, "interval_s": NUMBER, "max_gap_s": NUMBER, "recordings": {"type": "array", "items": TEXT}, "classify": FLAG}
    for f, parameters, required in (
        (own.list_folder, {"path": TEXT, "depth": WHOLE}, ("path",)),
        (own.inspect_survey, folder, ("videos_dir",)),
        (own.process_survey, folder | more, ("videos_dir", "output_dir")),
        (own.verify_geotags, {"output_dir": TEXT, "n": WHOLE}, ("output_dir",)),
        (own.concatenate_recordings, {"videos_dir": TEXT, "output_dir": TEXT}, ("videos_dir", "output_dir")),
        (own.classify_frames, {"output_dir": TEXT, "conf": NUMBER, "smooth_s": NUMBER}, ("output_dir",)),
        (own.search_documents, {"query": TEXT, "k": WHOLE}, ("query",)),
    ):
        tools.add(f, (f.__doc__ or "").strip(), parameters, required)
    return tools
