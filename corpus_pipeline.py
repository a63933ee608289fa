"""A corpus from documents to a training mix: each stage is one of the llm operators.

run() writes each stage's rows as Parquet in the shared folder and reads them as the next one's input,
so a stage that loses executors starts from files. All stages but the last return the columns of
documents; the last returns the mix: for each document that takes part, the words to take from it
(repeats counted) beside its size and its source's size and target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.common import cut, table
from thalweg.llm.decontaminate import drop_contaminated
from thalweg.llm.mixing import mix
from thalweg.llm.near_dups import drop_near_dups
from thalweg.llm.pii import mask_pii
from thalweg.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    return drop_near_dups(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in angle brackets."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from."""
    return mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dups", near_dups),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: The classifiers and the links of near copies are not for SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
