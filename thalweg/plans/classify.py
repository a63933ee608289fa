"""Classified frames and image folders, model evaluation, model cards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, names
from ..functions.clock import micros
from ..operators import classes


def classify_frames(frames: DataFrame, predictions: DataFrame, class_names: list[str], conf: float = 0.0, smooth_s: float = 0.0) -> DataFrame:
    """frames with benthic_class, class_conf, class_margin, raw_class (when smoothing), classified_path and prob_<class>.

    Only ok frames are classified; predictions(frame_id, probs) join on frame_id. Columns of an earlier
    classification are replaced. Smoothing is per recording and its folder.
    """
    stale = [c for c in frames.columns if c.startswith("prob_") or c in ("benthic_class", "class_conf", "class_margin", "raw_class", "classified_path")]
    rows = frames.drop(*stale)
    ok = rows.where("status = 'ok'").join(predictions.select("frame_id", "probs"), "frame_id")
    ok = ok.withColumn("raw_class", labels.label(class_names, F.col("probs"), conf)).withColumn("t", micros(F.col("ts_utc"))).withColumn("camera", F.concat_ws("/", "parent", "recording"))
    ok = classes.smooth(ok, len(class_names), smooth_s, by="camera")
    label = labels.label(class_names, F.col("probs"), conf)
    probs = [F.round(F.get("probs", k), 4).alias(f"prob_{n}") for k, n in enumerate(class_names)]
    found = ok.select("frame_id", label.alias("benthic_class"), F.round(F.array_max("probs"), 4).alias("class_conf"), F.round(labels.margin(F.col("probs")), 4).alias("class_margin"), *(["raw_class"] if smooth_s > 0 else []), *probs)
    out = rows.join(found, "frame_id", "left")
    return out.withColumn("classified_path", F.when(F.col("benthic_class").isNotNull(), F.concat(F.lit("classified/"), names.classified_name(F.col("benthic_class"), F.col("frame_filename")))))


def summary(classified: DataFrame, label: str = "benthic_class") -> DataFrame:
    """class, n, frames with a margin below 0.2."""
    return classified.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("class_margin") < 0.2).alias("low_margin"))


def classify_images(images: DataFrame, class_names: list[str], root: str, conf: float = 0.0) -> DataFrame:
    """images(path, name, probs[, latitude, longitude]) → a row per image with folder, class, margin, output path."""
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")
    position = [F.col(c) if c in images.columns else F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")]
    label = labels.label(class_names, F.col("probs"), conf)
    probs = [F.round(F.get("probs", k), 4).alias(f"prob_{n}") for k, n in enumerate(class_names)]
    return images.select(
        F.col("name").alias("filename"), names.parent_folder(relative).alias("folder"), label.alias("predicted_class"), F.round(F.array_max("probs"), 4).alias("confidence"),
        F.round(labels.margin(F.col("probs")), 4).alias("margin"), *probs, *position, F.col("path").alias("input_path"), names.classified_name(label, F.col("name")).alias("output_path"),
    )


def image_totals(rows: DataFrame) -> DataFrame:
    """One row: images, and how many have a position."""
    return rows.agg(F.count("*").alias("images"), F.count("latitude").alias("with_gps"))


def evaluate(rows: DataFrame, class_names: list[str]) -> dict[str, DataFrame]:
    """confusion, per_class, overall and misclassified of rows(image, truth, predicted[, conf])."""
    matrix = classes.confusion(rows, class_names)
    return {"confusion": matrix, "per_class": classes.per_class(matrix), "overall": classes.overall(matrix), "misclassified": classes.misclassified(rows)}


def model_card(name: str, metrics: dict | None = None, train_args: dict | None = None, dataset: str | None = None, leakage_pairs: int | None = None) -> str:
    """JSON; arguments that are no scalars as text."""
    plain = {k: v if isinstance(v, (str, int, float, bool, type(None))) else str(v) for k, v in (train_args or {}).items()}
    return json.dumps({"name": name, "dataset": dataset, "metrics": metrics, "train_args": plain, "leakage_pairs": leakage_pairs}, indent=2)
