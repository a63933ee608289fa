"""Class probabilities over tables: smoothing, counts, evaluation, crosstabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth(predictions: DataFrame, classes: int, window_s: float, by: str = "recording", t: str = "t") -> DataFrame:
    """Each class's mean over rows of the recording within window_s / 2 of the row, both ends included.

    predictions has probs: array<double> and t in microseconds; one range frame serves all classes.
    """
    if window_s <= 0:
        return predictions
    half = round(window_s * 1_000_000 / 2)
    w = Window.partitionBy(by).orderBy(t).rangeBetween(-half, half)
    return predictions.withColumn("probs", F.array(*(F.avg(F.get("probs", k)).over(w) for k in range(classes))))


def class_counts(rows: DataFrame, column: str = "label") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def unknown(rows: DataFrame, classes: list) -> DataFrame:
    """True classes that the model doesn't have."""
    return rows.where(~F.col("truth").isin(classes)).select("truth").distinct()


def confusion(rows: DataFrame, classes: list) -> DataFrame:
    """rows(truth, predicted) → a row per pair of classes, zeros included, and its share of the true class."""
    strange = unknown(rows, classes).limit(20).collect()
    if strange:
        raise ValueError(f"classes the model doesn't have: {sorted(str(r.truth) for r in strange)}")
    spark = rows.sparkSession
    # the classes of a model are a short list
    every = spark.createDataFrame([(a, b) for a in classes for b in classes], f"truth {rows.schema['truth'].dataType.simpleString()}, predicted {rows.schema['predicted'].dataType.simpleString()}")
    counts = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    full = every.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("truth"))
    return full.withColumn("row_share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (four places, 0 where undefined) and support of each class of a confusion matrix."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("truth").alias("class")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guessed"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    both = rows.join(cols, "class").withColumn("p", p).withColumn("r", r).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return both.select("class", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"), "support")


def overall(matrix: DataFrame) -> DataFrame:
    """Accuracy, and macro F1: the mean of the rounded F1 of the classes that have rows."""
    acc = matrix.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"), F.sum("n").alias("n"))
    macro = per_class(matrix).where("support > 0").agg(F.avg("f1").alias("m"))
    joined = acc.withColumn("one", F.lit(1)).join(macro.withColumn("one", F.lit(1)), "one")
    return joined.select(F.round("a", 4).alias("accuracy"), F.round("m", 4).alias("macro_f1"), "n")


def misclassified(rows: DataFrame) -> DataFrame:
    return rows.where("truth <> predicted")


def top_per_class(rows: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """The row with the highest score of each label."""
    rest = [c for c in rows.columns if c != label]
    best = rows.groupBy(label).agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(tie))).alias("r"))
    return best.select(label, *(F.col(f"r.{c}").alias(c) for c in rest))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str], missing: str = "(top level)") -> DataFrame:
    """Counts of row × column, zeros filled, a null or empty row under its own name."""
    named = rows.withColumn(row, F.when(F.coalesce(F.col(row), F.lit("")) == "", missing).otherwise(F.col(row)))
    return named.groupBy(row).pivot(column, values).count().fillna(0)
