"""Streams of probes and track points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import asof


def tag_arrivals(probes: DataFrame, track: Callable[[], DataFrame], output: str, checkpoint: str, max_gap_s: float = 60.0) -> StreamingQuery:
    """Interpolates each batch of a stream of probes(track_id, t, ...) against the track as it is then.

    A batch overwrites its own folder, so a batch that runs again leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        asof.interpolate(batch, track(), max_gap_s).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return probes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_per_window(tagged: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by status and window of a stream with ts; windows close `late` after the newest time seen."""
    return tagged.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
