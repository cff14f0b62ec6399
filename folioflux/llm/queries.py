"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflux.llm.decontamination import op7_contamination
from folioflux.llm.gif import op10_media
from folioflux.llm.jaccard_join import op1_classes
from folioflux.llm.language_id import op3_languages
from folioflux.llm.ngram_lm import op2_scores
from folioflux.llm.oracles import DECONTAMINATION, NGRAM_JACCARD
from folioflux.llm.packing import op9_pieces
from folioflux.llm.quality import op8_scores
from folioflux.llm.sharding import op6_shards
from folioflux.llm.toxicity import op4_scores
from folioflux.llm.warc import ORACLE_SQL as REVISITS_SQL
from folioflux.llm.warc import op5_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_classes(_documents(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_scores(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_revisits(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_shards(_documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pieces(_documents(spark, sf_dir))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_lm_score": op2_lm_score,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_gif": op10_gif,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op5_warc_revisits": REVISITS_SQL,
    "op7_decontamination": DECONTAMINATION,
}
