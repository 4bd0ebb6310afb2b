"""The corpus pipeline: quality rules, quality classifier, near-duplicate
removal, best-fit packing. Every stage works on all rows that the one before
kept; its result is written as Parquet and read again for the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm.bin_packing import best_fit_packing
from tillbook.llm.co_training import filter_by_classifier
from tillbook.llm.common import stored
from tillbook.llm.near_dedup import drop_near_duplicates
from tillbook.llm.quality_rules import filter_quality
from tillbook.llm.vocabularies import vocabulary

# SQL can express neither EM, nor the classifier, nor the packing
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return filter_quality(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return filter_by_classifier(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more)."""
    return drop_near_duplicates(docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return best_fit_packing(docs, vocabulary(spark, "word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        frame = stored(stage(spark, frame, sf_dir), f"stage-{name}")
    return frame
