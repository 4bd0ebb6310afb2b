"""A1 load_ledger, A4 write_snapshot, A5 read_commands: ledger tables and
command files on storage (parquet / json / csv with explicit schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.sources.schemas import LEDGER_SCHEMAS, conform


def load_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """A1: every ledger table from ``path/<table>`` with its explicit schema
    (no inference); missing columns read as NULL or their default."""
    out = {}
    for name, schema in LEDGER_SCHEMAS.items():
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", "true")
        out[name] = conform(reader.format(fmt).load(f"{path}/{name}"), name)
    return out


def write_snapshot(df: DataFrame, path: str, day_col: str = "fecha_hora", batch: str | int = 0) -> None:
    """A4: snapshot rows partitioned by business day (partition pruning on day
    filters) and batch. A batch owns its partitions and writes each as a whole
    (dynamic partition overwrite), so a write that is repeated after a failure
    leaves the table as one write does, and no batch touches another's files.
    Rows without a day are in a partition of their own."""
    (df.withColumns({"dia": F.to_date(F.col(day_col)), "lote": F.lit(str(batch))}).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("dia", "lote").parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A4: the rows of all batches; ``dia`` prunes partitions."""
    return spark.read.parquet(path).drop("lote")


# Text form of command timestamps (microseconds kept).
COMMAND_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_commands(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False,
                  fmt: str = "json") -> DataFrame:
    """A5: bulk (or streaming) ingest of posting commands with a fixed schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("timestampNTZFormat", COMMAND_TS_FORMAT).format(fmt).load(path)


def write_commands(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Command files in the format ``read_commands`` reads."""
    df.write.mode("overwrite").option("timestampNTZFormat", COMMAND_TS_FORMAT).format(fmt).save(path)
