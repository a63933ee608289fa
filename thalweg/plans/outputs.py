"""What a survey, a classification or an evaluation leaves behind, written so that inputs are never lost.

Each output is a folder of its own and only these are replaced; a version is written beside the old one
before that goes. Small reports are JSON lines of one row.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classes, reports
from . import classify

#: The only names below an output folder that are ever deleted.
MANAGED = ("frames", "frames_csv", "frames_geojson", "report", "overlap", "geotagged", "untagged", "classified", "plots")
CLASSES_OF = ("benthic_class", "class_conf", "class_margin")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def clear(spark: SparkSession, output: str, names: tuple[str, ...] = MANAGED) -> list[str]:
    """Delete the managed outputs that are there; everything else in the folder stays. Names of what went."""
    gone = []
    for name in names:
        if name not in MANAGED:
            raise ValueError(f"{name} is no managed output")
        fs, where = _path(spark, f"{output}/{name}")
        if fs.delete(where, True):
            gone.append(name)
    return gone


def replace(rows: DataFrame, path: str, write) -> None:
    """write(rows, new path), then put it in the place of path: rows may have been read from there."""
    spark = rows.sparkSession
    fs, old = _path(spark, path)
    _, new = _path(spark, path + "._new")
    fs.delete(new, True)
    write(rows, path + "._new")
    fs.delete(old, True)
    fs.rename(new, old)


def as_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def as_text(rows: DataFrame, path: str) -> None:
    rows.write.text(path)


def as_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def write_classified(classified: DataFrame, output: str) -> dict:
    """The frame table with its classes as Parquet and CSV, classes in the features, a classification in the report.

    classified comes from classify_frames(). Without a class the columns are empty. Returns the report's part.
    """
    spark = classified.sparkSession
    replace(classified, f"{output}/frames", lambda d, p: d.write.parquet(p))
    kept = spark.read.parquet(f"{output}/frames")
    replace(kept, f"{output}/frames_csv", as_csv)
    probs = [c for c in kept.columns if c.startswith("prob_")]
    added = kept.where("benthic_class IS NOT NULL").select("frame_id", *CLASSES_OF, *probs)
    replace(reports.merge_features(spark.read.text(f"{output}/frames_geojson").withColumnRenamed("value", "feature"), added, "frame_id"), f"{output}/frames_geojson", as_text)
    summary = {r.benthic_class: (r.n, r.low_margin) for r in classify.summary(kept).collect()}
    part = {"class_counts": {k: n for k, (n, _) in sorted(summary.items())}, "low_margin_frames": sum(x for _, x in summary.values())}
    merge_report(spark, output, "classification", part)
    return part


def merge_report(spark: SparkSession, output: str, key: str, part: dict) -> dict:
    """Set key of the report, which is one row; what else it has stays."""
    rows = [json.loads(r.value) for r in spark.read.text(f"{output}/report").limit(2).collect()]
    if len(rows) != 1:
        raise ValueError(f"{output}/report has no single row")
    new = rows[0] | {key: part}
    replace(spark.createDataFrame([(json.dumps(new, sort_keys=True),)], "value string"), f"{output}/report", as_text)
    return new


def write_image_summary(rows: DataFrame, output: str) -> dict:
    """summary (CSV) and results (JSON) of classified images."""
    replace(rows, f"{output}/summary", as_csv)
    kept = rows.sparkSession.read.option("header", "true").csv(f"{output}/summary")
    total = classify.image_totals(kept).first()
    counts = {r.predicted_class: r.n for r in classes.class_counts(kept, "predicted_class").collect()}
    result = {"images": total.images, "with_gps": total.with_gps, "class_counts": dict(sorted(counts.items()))}
    replace(rows.sparkSession.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string"), f"{output}/classification_results", as_text)
    return result


def write_metrics(evaluation: dict[str, DataFrame], output: str) -> None:
    """metrics (one JSON row: accuracy, macro F1, a row for each class, the matrix) and misclassified (CSV)."""
    per = evaluation["per_class"].agg(F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("per_class"))
    matrix = evaluation["confusion"].agg(F.array_sort(F.collect_list(F.struct("truth", "predicted", "n"))).alias("confusion"))
    one = F.lit(1).alias("one")
    metrics = evaluation["overall"].select("*", one).join(per.select("*", one), "one").join(matrix.select("*", one), "one").drop("one")
    replace(metrics, f"{output}/metrics", as_json)
    replace(evaluation["misclassified"], f"{output}/misclassified", as_csv)


def plot_tables(frames: DataFrame, track: DataFrame | None = None, confusion: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the three plots draw: track and frame positions by status, class counts, row shares of the matrix."""
    out = {"positions": frames.where("status = 'ok'").select(F.lit("frame").alias("layer"), F.col("longitude").alias("x"), F.col("latitude").alias("y"), "depth_m")}
    if track is not None:
        out["positions"] = track.select(F.lit("track"), "lon", "lat", "depth").union(out["positions"]).toDF("layer", "x", "y", "depth_m")
    if "benthic_class" in frames.columns:
        out["classes"] = classes.class_counts(frames.where("benthic_class IS NOT NULL"), "benthic_class")
    if confusion is not None:
        out["confusion"] = confusion.select("truth", "predicted", "row_share")
    return out


def write_plot_tables(tables: dict[str, DataFrame], output: str) -> dict[str, str]:
    """Each table as CSV below plots; a table that fails is reported and doesn't stop the others."""
    said = {}
    for name, rows in tables.items():
        try:
            replace(rows, f"{output}/plots/{name}", as_csv)
            said[name] = "written"
        except Exception as e:  # plots are extras
            said[name] = f"{type(e).__name__}: {e}"
    return said
