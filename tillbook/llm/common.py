"""Helpers shared by the operators: shared storage for intermediate tables,
keys that identify a document, and Arrow batch iteration."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BYTES = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a
    local session gets a scratch folder; a cluster session is refused, since
    a machine-local folder would lose data there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tillbook-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate table."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    lineage is cut, and a lost executor only repeats tasks that read files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def document_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that identify a document even if ids repeat or are null:
    the id, and a 64-bit hash of the text (null texts hash apart from '')."""
    return [F.col(id_col).alias("k_id"),
            F.xxhash64(F.col(text_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias("k_text")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text) is in ``kept`` (columns k_id, k_text);
    all columns of ``docs`` stay as they are and repeated rows stay repeated."""
    k_id, k_text = document_key(id_col, text_col)
    right = kept.select(F.col("k_id").alias("__k_id"), F.col("k_text").alias("__k_text")).distinct()
    cond = docs[id_col].eqNullSafe(right["__k_id"]) & (
        F.xxhash64(docs[text_col].isNull(), F.coalesce(docs[text_col], F.lit(""))) == right["__k_text"])
    return docs.join(right, cond, "left_semi")


def texts(batch: pa.RecordBatch, column: str | int):
    """The column's values one after the other, without a list of all."""
    for value in batch.column(column):
        yield value.as_py()


def map_arrow(df: DataFrame, make_batch, schema: str) -> DataFrame:
    """``mapInArrow`` where ``make_batch`` turns a record batch into one."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make_batch(batch)
    return df.mapInArrow(run, schema)
