"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.oracles import ORACLES  # noqa: F401  (part of the entry's contract)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("k_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.byte_bpe import byte_bpe
    from tillbook.llm.vocabularies import vocabulary

    return (byte_bpe(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_multi_50k.tiktoken"))
            .withColumnRenamed("id", "doc_id"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.sharding import vector_shards

    return vector_shards(table(spark, sf_dir, "documents"), 16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.url_filter import url_filter

    return (url_filter(table(spark, sf_dir, "pages"), URL_RULES)
            .select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.bin_packing import best_fit_packing
    from tillbook.llm.vocabularies import vocabulary

    return (best_fit_packing(table(spark, sf_dir, "documents"), vocabulary(spark, "word_bpe_49k.json"))
            .withColumnRenamed("id", "doc_id"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.warc import convert_pages

    return convert_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.co_training import co_training

    return (co_training(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select(F.col("k_id").alias("doc_id"), "text_score", "meta_score", "score", "kept"))


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("k_id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.nn_descent import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.sentence_pieces import sentence_pieces
    from tillbook.llm.vocabularies import vocabulary

    return (sentence_pieces(table(spark, sf_dir, "documents"), vocabulary(spark, "piece_bpe_32k.model"))
            .withColumnRenamed("id", "doc_id"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.conversation_repair import damage, repair_conversations

    return repair_conversations(damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillbook.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).withColumnRenamed("id", "doc_id").drop("n_words")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
