"""Gap-aware as-of interpolation.

A probe lies on the segment between the last point at or before it and the next one. Segments no
longer than the gap limit touch at most two time buckets of that width, so the range condition becomes
an equi-join on (track, bucket) with at most two rows per segment; longer segments can't give an
answer and are not joined. Status of the rest comes from each track's first and last time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import between
from .track import bounds, segments


def interpolate(probes: DataFrame, track: DataFrame, max_gap_s: float = 60.0) -> DataFrame:
    """probes(track_id, t, ...) with lat, lon, depth and status; t in microseconds.

    ok: on a segment within max_gap_s. before_track, after_track: outside (a track of one point is always
    either). gps_gap: on a longer segment, also exactly on a point that a longer segment follows.
    """
    width = max(1, round(max_gap_s * 1_000_000))
    bucket = F.floor(F.col("t") / width)
    seg = segments(track).where(F.col("tb") - F.col("ta") <= width)
    seg = seg.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ta") / width), F.floor(F.col("tb") / width))))
    p = probes.withColumn("bucket", bucket).alias("p")
    on = (F.col("p.track_id") == F.col("s.track_id")) & (F.col("p.bucket") == F.col("s.bucket")) & (F.col("p.t") >= F.col("s.ta"))
    on &= (F.col("p.t") < F.col("s.tb")) | (F.col("s.last") & (F.col("p.t") == F.col("s.tb")))
    rows = p.join(seg.alias("s"), on, "left")
    r = (F.col("p.t") - F.col("s.ta")) / (F.col("s.tb") - F.col("s.ta"))
    found = rows.select("p.*", *(between(r, F.col(f"s.a.{c}"), F.col(f"s.b.{c}")).alias(c) for c in ("lat", "lon", "depth")), F.col("s.ta").isNotNull().alias("hit")).drop("bucket")
    edges = bounds(track).withColumnRenamed("track_id", "edge_of")
    out = found.join(edges, F.col("track_id") == F.col("edge_of"), "left")
    before = (F.col("t") < F.col("g0")) | ((F.col("n") == 1) & (F.col("t") == F.col("g0")))
    status = F.when(F.col("hit"), "ok").when(before | F.col("g0").isNull(), "before_track").when((F.col("t") > F.col("g1")) | (F.col("n") == 1), "after_track").otherwise("gps_gap")
    return out.withColumn("status", status).drop("hit", "edge_of", "g0", "g1", "n")
