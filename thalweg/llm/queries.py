"""The queries opN_<name> with production parameters, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .cover_tree import LINK_SQL
from .mixing import MIX_SQL
from .near_dups import NEAR_SQL
from .warc import WARC_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL["op2_cover_tree_near_dups"] = LINK_SQL
ORACLE_SQL["op4_minhash_near_dups"] = NEAR_SQL
ORACLE_SQL["op6_warc_revisits"] = WARC_SQL
ORACLE_SQL["op7_source_mixing"] = MIX_SQL


@query
def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=2)


@query
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_cover_tree_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import link

    return link(table(spark, sf_dir, "embeddings"))


@query
def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import ALL, contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ALL)


@query
def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))
