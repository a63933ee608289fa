"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased; features are the distinct words, pairs of
neighbours and pairs with up to SKIPS words between, hashed into 2 ** BITS slots. The model is fitted
on at most TRAIN labelled rows in hash order, never on held-out ones (crc32 of the doc_id as text, mod
4, is 2), fewer if their features are above FEATURE_BYTES; its non-zero weights, bounded by the number of
slots, go to the executors. Labels and all columns but the text stay out of scores.

Null and empty texts score the bias alone. Rows are scored one by one: repeated rows score alike and
extra columns are ignored; of rows with one doc_id the first by its columns is learnt from, under the largest of
its labels. Null labels and labels of other documents are not used; without labels of
both classes every score is 0.5. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_arrow_batches
from .linear import MARKS, Ftrl, Sparse, grams, sigmoid, slots, tokens

BITS, SKIPS, TRAIN, EPOCHS, CUT, FEATURE_BYTES = 20, 1, 8000, 12, 0.3, 400_000_000
ALPHA, L1, L2 = 1.0, 8.0, 0.02


def features(text: str | None) -> np.ndarray:
    words, _ = tokens((text or "").encode("utf-8", "surrogatepass").lower(), MARKS)
    return slots(grams(words, SKIPS), BITS)


def fold(doc_id):
    """crc32 of the doc_id as text, mod 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], most: int) -> DataFrame:
    """(doc_id, y, columns) of at most `most` labelled documents outside the held-out fold, in hash order."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row"), F.first("y").alias("y"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "row.*")


def bounded_rows(features: DataFrame, columns: list[str], most: int = FEATURE_BYTES) -> list:
    """The rows of features(doc_id, y, binary columns) in hash order, as many as have `most` bytes together.

    features has the few thousand rows of a labelled sample; only their sizes are collected before the cut.
    """
    features = cut(features.withColumn("place", F.xxhash64("doc_id")), "features")
    size = sum((F.length(c) for c in columns[1:]), F.length(columns[0]))
    total, last = 0, None
    for r in sorted(features.select("place", size.alias("size")).collect()):
        total += r["size"]
        if total > most:
            break
        last = r["place"]
    return sorted(features.where(F.col("place") <= last).collect(), key=lambda r: (r["place"], r["doc_id"])) if last is not None else []


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.unique(features(t.as_py())).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "toxic", ["text"], most).select("doc_id", "text", "y")
    rows = bounded_rows(sample.mapInArrow(run, "doc_id long, y int, x binary"), ["x"])
    model = Ftrl(BITS, alpha=ALPHA, l1=L1, l2=L2)
    if {r.y for r in rows} >= {0, 1}:
        model.fit([np.frombuffer(r.x, np.int32) for r in rows], np.array([r.y for r in rows], float), EPOCHS)
    return model.compact()


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = CUT, most: int = TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""
    small_arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Sparse(BITS, *model.value)
        for b in batches:
            p = [float(sigmoid(table.margin(features(t.as_py())))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
