"""GPX tracks: every track point of every file, whatever namespaces and extensions it uses."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tag(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1].lower()


def points(xml: str | bytes) -> list[tuple[int, float, float, float | None]]:
    """(t in microseconds, lat, lon, depth) of points with a time: the last time and the last depth that
    parses count; times without a zone are UTC; one point per time, the first in the file."""
    found: dict[int, tuple] = {}
    for p in ET.fromstring(xml).iter():
        if _tag(p) != "trkpt":
            continue
        when = depth = None
        for e in p.iter():
            said = (e.text or "").strip()
            if _tag(e) == "time" and said:
                when = said
            elif _tag(e) == "depth":
                try:
                    depth = float(said)
                except ValueError:
                    continue
        if when is None:
            continue
        t = datetime.fromisoformat(when.replace("Z", "+00:00"))
        t = t if t.tzinfo else t.replace(tzinfo=UTC)
        micros = round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
        found.setdefault(micros, (micros, float(p.attrib["lat"]), float(p.attrib["lon"]), None if depth is None or depth != depth else depth))
    return [found[t] for t in sorted(found)]


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(track_id = path, t, lat, lon, depth); a file without timed points fails the read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = points(content)
                if not rows:
                    raise ValueError(f"{name}: no track points with a time")
                yield pd.DataFrame(rows, columns=["t", "lat", "lon", "depth"]).assign(track_id=name)[["track_id", "t", "lat", "lon", "depth"]]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".gpx") & ~F.col("path").rlike(r"/\._[^/]*$"))
    return files.select("path", "content").mapInPandas(run, "track_id string, t long, lat double, lon double, depth double")
