"""Report tables: counts, samples, listings, symbol maps, last turns, best rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import position_error_m


def status_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("status").agg(F.count("*").alias("n"))


def systematic_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Rows 0, step, 2 step, ... in order, n at most, with step = max(1, count // n).

    Positions are counted by ranges of the order, so the whole table is never sorted in one task.
    """
    from .search import ranked

    total = rows.count()
    at = ranked(rows.withColumn("back", -F.col(order).cast("double")), "back", order, "position").drop("back")
    step = max(1, total // n)
    return at.where(((F.col("position") - 1) % step == 0) & (F.col("position") <= step * n)).drop("position")


def folder_counts(files: DataFrame, depth: int = 2, most: int = 200) -> DataFrame:
    """files(path relative to the root) → dir, videos, gpx, jpg per folder; hidden folders left out; first `most` by name."""
    depth = max(1, min(depth, 4))
    d = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.select(d.alias("dir"), ext.alias("ext")).where(~F.col("dir").rlike(r"(^|/)\.") & (F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))) <= depth))
    out = rows.groupBy("dir").agg(F.count_if(F.col("ext").isin(".mp4", ".mov", ".avi", ".mkv")).alias("videos"), F.count_if(F.col("ext") == ".gpx").alias("gpx"), F.count_if(F.col("ext").isin(".jpg", ".jpeg")).alias("jpg"))
    return out.orderBy("dir").limit(most)


def symbol_map(chunks: DataFrame) -> DataFrame:
    """chunks(repo, path, ord, symbol) → a line per file: its distinct symbols in order of appearance."""
    first = chunks.groupBy("repo", "path", "symbol").agg(F.min("ord").alias("ord"))
    grouped = first.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("ord", "symbol")))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["symbol"]), "; ")
    return grouped.select("repo", "path", F.concat(F.lit("- "), "repo", F.lit("/"), "path", F.when(F.size("s") > 0, F.concat(F.lit(": "), joined)).otherwise("")).alias("line"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def best_row(rows: DataFrame, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The row with the largest score, the smallest tie among equals; of all rows or of each group."""
    rest = [c for c in rows.columns if c not in (by or [])]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(tie))).alias("r")
    out = rows.groupBy(*by).agg(best) if by else rows.agg(best)
    return out.select(*(by or []), "r.*")


def best_views(runs: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the augmentation with the best macro F1; hflip first among equals, then the last by name."""
    rest = [c for c in runs.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct("macro_f1", F.col("tta") == "hflip", "tta")).alias("r")
    return runs.groupBy(*by).agg(best).select(*by, "r.*")


def verified(frames: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """frames(key, latitude, longitude) against tags(key, lat, lon) read back from files: has_gps and max_error_m."""
    both = frames.join(tags.select(key, F.col("lat").alias("tag_lat"), F.col("lon").alias("tag_lon")), key, "left")
    has = F.col("tag_lat").isNotNull() & F.col("tag_lon").isNotNull()
    error = position_error_m(F.col("latitude"), F.col("longitude"), F.col("tag_lat"), F.col("tag_lon"))
    return both.withColumn("has_gps", has).withColumn("max_error_m", F.when(has, error))


def merge_features(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """features(feature: GeoJSON text) with the columns of rows as further properties, joined on the property key.

    Features without a row stay as they are; of several rows with one key the last by its columns counts.
    """
    added = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(*added)).alias("more"))
    text = F.to_json("more", {"ignoreNullFields": "false"})
    joined = features.withColumn(key, F.get_json_object("feature", f"$.properties.{key}")).join(last, key, "left")
    # properties are the last member of a feature: its object goes on before the closing braces
    grown = F.concat(F.regexp_replace("feature", r"\}\s*\}\s*$", ","), F.substring(text, 2, 1 << 30), F.lit("}"))
    return joined.select(F.when(F.col("more").isNotNull(), grown).otherwise(F.col("feature")).alias("feature"))


def plain_number(x: Column) -> Column:
    """A double as JSON: digits from 1e-4 to 1e16 (Spark's own text has an exponent from 1e-3 down and 1e7 up), else like 5e-05."""
    own = x.cast("string")
    digits = F.regexp_replace(own.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"(?:\.0)?E", "e"), r"e(\d)", "e+$1"), r"e-(\d)$", "e-0$1")
    size = F.abs(x)
    return F.when(~own.contains("E"), own).when((size >= 1e-4) & (size < 1e16), digits).otherwise(exponent)


def geojson_features(frames: DataFrame) -> DataFrame:
    """A GeoJSON feature (as text) for each ok frame; properties are all but position and path."""

    def text(name: str) -> Column:
        value = F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
        if frames.schema[name].dataType.typeName() != "double":
            return value
        # what is no number stays as to_json writes it
        return F.when(F.col(name).isNull() | F.isnan(name) | (F.abs(F.col(name)) == float("inf")), value).otherwise(plain_number(F.col(name)))

    props = [c for c in frames.columns if c not in ("latitude", "longitude", "path")]
    members = [F.concat(F.lit(("," if k else "") + json.dumps(c, ensure_ascii=False) + ":"), text(c)) for k, c in enumerate(props)]
    start = F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[')
    feature = F.concat(start, text("longitude"), F.lit(","), text("latitude"), F.lit(']},"properties":{'), *members, F.lit("}}"))
    return frames.where("status = 'ok'").select(feature.alias("feature"))
