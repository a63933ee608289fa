"""What needs programs or libraries outside Spark: media metadata, frames, EXIF, models.

Each adapter runs on executors, one file per row, and yields nulls where its tool is missing or fails,
so that plans around it work without the tool.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import description, dms, with_class


def run(args: list[str], timeout: int = 120) -> str | None:
    try:
        done = subprocess.run(args, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def find_tool(name: str) -> str | None:
    return os.environ.get(name.upper()) or shutil.which(name)


def probe(path: str) -> dict:
    """create_date and creation_time (texts) and duration of a media file, as far as tools can tell."""
    local = path.removeprefix("file:")
    out: dict = {"create_date": None, "creation_time": None, "duration_s": None}
    if tool := find_tool("exiftool"):
        said = run([tool, "-s3", "-CreateDate", local])
        out["create_date"] = (said or "").strip() or None
    if tool := find_tool("ffprobe"):
        said = run([tool, "-v", "error", "-show_entries", "format=duration:format_tags=creation_time", "-of", "json", local])
        form = json.loads(said or "{}").get("format", {})
        out["creation_time"] = form.get("tags", {}).get("creation_time")
        out["duration_s"] = float(form["duration"]) if "duration" in form else None
    return out


def probed(files: DataFrame, tool: Callable[[str], dict] = probe) -> DataFrame:
    """files with start_local (naive) and duration_s."""
    cols = files.columns

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame([tool(p) for p in f["path"]], columns=["create_date", "creation_time", "duration_s"])], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", create_date string, creation_time string, duration_s double"
    rows = files.mapInPandas(each, schema)
    return rows.select(*cols, start_time(F.col("create_date"), F.col("creation_time")).alias("start_local"), "duration_s")


def start_time(create_date: Column, creation_time: Column) -> Column:
    """The camera clock: CreateDate unless it is zeros, else creation_time read as local whatever its zone says."""
    first = F.when(~create_date.startswith("0000"), F.try_to_timestamp(F.substring(create_date, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")))
    second = F.try_to_timestamp(F.regexp_replace(F.substring(creation_time, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(first, second).cast("timestamp_ntz")


def duration(n_frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, n_frames / fps).otherwise(0.0)


def exif_columns(frames: DataFrame) -> DataFrame:
    """What a geotag of each ok frame holds: references, degrees as rationals, description."""
    tags = frames.where("status = 'ok'")
    return tags.select(
        "*", F.when(F.col("latitude") >= 0, "N").otherwise("S").alias("lat_ref"), dms(F.col("latitude")).alias("lat_dms"), F.when(F.col("longitude") >= 0, "E").otherwise("W").alias("lon_ref"),
        dms(F.col("longitude")).alias("lon_dms"), description(F.col("depth_m")).alias("image_description"),
    )


def class_tag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("image_description", with_class(F.col("image_description"), F.col("benthic_class")))


def concat_manifest(recordings: DataFrame) -> DataFrame:
    """Which recordings to join from several chapters, and which to skip."""
    return recordings.select("parent", "recording", "n_chapters", F.when(F.col("n_chapters") > 1, "concatenate").otherwise("skip").alias("action"), F.col("chapters.path").alias("paths"))


def predict(images: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], tta: str = "hflip", batch: int = 16) -> DataFrame:
    """images(image_id, path) with probs: the mean over views of load()(paths, view), loaded once per task."""
    from ..functions.labels import views

    n = views(tta)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            paths, out = f["path"].tolist(), []
            for k in range(0, len(paths), batch):
                part = paths[k : k + batch]
                out += list(np.mean([np.asarray(model(part, v), float) for v in range(n)], axis=0))
            yield f.assign(probs=[x.tolist() for x in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields) + ", probs array<double>"
    return images.mapInPandas(each, schema)


def embed(chunks: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", most: int = 2000, batch: int = 32) -> DataFrame:
    """chunks with a unit vector of the first `most` characters; null vectors if the model can't be loaded."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = load()
        except Exception:  # lexical search goes on without vectors
            model = None
        for f in frames:
            vectors: list = [None] * len(f)
            if model:
                said, vectors = [str(x or "")[:most] for x in f[text]], []
                for k in range(0, len(said), batch):
                    v = np.asarray(model(said[k : k + batch]), float)
                    vectors += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
            yield f.assign(vector=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", vector array<double>"
    return chunks.mapInPandas(each, schema)
