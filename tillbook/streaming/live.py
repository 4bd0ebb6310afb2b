"""Group J: Structured Streaming versions of the live dashboard.

Sources are file streams (new parquet files of commands); sinks are parquet
tables under ``spark.checkpoint.dir`` (the shared folder of the cluster), so
a lost executor or driver restart resumes from the stream checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.functions.signs import POST_RULES, signed_legs
from tillbook.operators.joins import with_commission
from tillbook.operators.postings import store_and_bank_legs
from tillbook.session import ensure_checkpoint_dir
from tillbook.sources.schemas import LEDGER_SCHEMAS, MONEY_SQL
from tillbook.streaming.keyed import net_changes, net_events, overlay, pending_state, rocksdb_state, totals


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """File stream of one table (a file, or a folder of part files; new files
    are picked up as they land). ``max_files`` bounds the files of one
    micro-batch; unset, a catch-up run takes all that is there."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a stream takes a plain path as a folder only; this glob matches that one
    # path, be it a file or a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def ledger_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """File stream of one table of a stored ledger."""
    reader = spark.readStream.schema(LEDGER_SCHEMAS[table])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder.rstrip('/')}/{table}")


def post_commands(cmds: DataFrame, com: DataFrame) -> DataFrame:
    """J3 rule: the I1 postings of valid commands."""
    c = with_commission(cmds.filter(F.col("monto") > 0), com)
    cash, bank = signed_legs(F.col("tipo"), F.col("monto"), F.col("com_ef"), F.col("com_vi"), POST_RULES)
    c = c.withColumn("monto_efectivo", cash).withColumn("monto_banco", bank)
    return store_and_bank_legs(c, "fecha_hora", F.col("monto_efectivo"), F.col("monto_banco"), "transaccion", "id", 1)


def run_post(cmd_stream: DataFrame, com: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """I1 on a command stream. Every distinct command is posted exactly
    once, however late or out of order it arrives: the ids taken so far are
    the stream's own state (RocksDB, one lookup per command that arrives), and
    there is no watermark, so none is forgotten. The first delivery counts; of
    deliveries in one micro-batch, the one that Spark reads first. Each batch
    writes folders of its own (``lote=<epoch>``) and overwrites them when it is
    replayed after a failure, so a replay changes nothing. ``path`` gets
    ``postings``, ``rechazados`` (amounts that are not > 0) and ``nuevos``."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = f"{path}/nuevos/lote={epoch}"
        batch.write.mode("overwrite").parquet(new)
        one = spark.read.schema(batch.schema).parquet(new)
        post_commands(one, com).write.mode("overwrite").parquet(f"{path}/postings/lote={epoch}")
        one.filter(~F.coalesce(F.col("monto") > 0, F.lit(False))) \
           .write.mode("overwrite").parquet(f"{path}/rechazados/lote={epoch}")
    with rocksdb_state(cmd_stream.sparkSession):
        return (cmd_stream.dropDuplicates(["id"]).writeStream.foreachBatch(write).option("checkpointLocation", path + "/_checkpoint")
                          .trigger(**(trigger or CATCH_UP_TRIGGER)).start())


def run_daily_flow(tx_stream: DataFrame, path: str, delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Per day and type, cash in / out, without losing late rows. After a
    micro-batch the watermark is the last event time so far minus ``delay``; a
    day is emitted once its end is at or before it. Rows of a day that the
    watermark had passed before their batch, and rows without a time, go to
    ``tardias`` as they are. ``path`` gets ``flujo`` (dia_inicio, tipo, entrada,
    salida, ops), ``tardias``, ``sumas`` (the days that were open when the batch
    came, with its rows) and ``marca`` (the last event time). A batch reads its
    own rows and the two small versions before it, whatever the stream's age.
    Each batch writes folders of its own (``lote=<epoch>``) and overwrites them
    when it is replayed."""
    m = F.col("monto_efectivo")
    end = F.col("dia_inicio") + F.expr("INTERVAL 1 DAY")
    wait = F.expr(f"INTERVAL {delay}")
    sums = [F.sum("entrada").cast(MONEY_SQL).alias("entrada"), F.sum("salida").cast(MONEY_SQL).alias("salida"), F.sum("ops").alias("ops")]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def mark(of: int):
            """The last event time up to a batch, as a lazy one-row value."""
            return spark.read.schema("visto timestamp_ntz").parquet(f"{path}/marca/lote={of}").agg(F.max("visto")).scalar()

        def passed(of: int):
            return F.coalesce(end <= mark(of) - wait, F.lit(False))

        rows = batch.withColumn("dia_inicio", F.date_trunc("day", "fecha_hora").cast("timestamp_ntz"))
        late = F.col("dia_inicio").isNull()
        if epoch > 0:
            late = late | passed(epoch - 1)
        rows.filter(late).drop("dia_inicio").write.mode("overwrite").parquet(f"{path}/tardias/lote={epoch}")
        own = rows.filter(~late)
        parts = own.select("dia_inicio", "tipo", F.when(m > 0, m).otherwise(F.lit(0)).cast(MONEY_SQL).alias("entrada"),
                           F.when(m < 0, -m).otherwise(F.lit(0)).cast(MONEY_SQL).alias("salida"), F.lit(1).cast("long").alias("ops"))
        seen = own.agg(F.max(F.col("fecha_hora").cast("timestamp_ntz")).alias("visto"))
        if epoch > 0:
            before = spark.read.schema(PARTIAL_SCHEMA).parquet(f"{path}/sumas/lote={epoch - 1}")
            parts = parts.unionByName(before.filter(~passed(epoch - 1)))
            seen = seen.select(F.greatest("visto", mark(epoch - 1)).alias("visto"))
        seen.write.mode("overwrite").parquet(f"{path}/marca/lote={epoch}")
        parts.groupBy("dia_inicio", "tipo").agg(*sums).write.mode("overwrite").parquet(f"{path}/sumas/lote={epoch}")
        now = spark.read.schema(PARTIAL_SCHEMA).parquet(f"{path}/sumas/lote={epoch}")
        now.filter(passed(epoch)).write.mode("overwrite").parquet(f"{path}/flujo/lote={epoch}")
    return (tx_stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "/_checkpoint")
                     .trigger(**(trigger or CATCH_UP_TRIGGER)).start())


def run_net(tx_stream: DataFrame, ap_stream: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Live net cash per (store, bank) since the store's latest opening,
    over a stream of transactions and one of openings. An opening resets the
    store when it arrives, also behind transactions that came before it. Each
    micro-batch writes a version of the parts' nets; ``current_net`` reads it."""
    def write(batch: DataFrame, epoch: int) -> None:
        overlay(batch, epoch, f"{path}/data", ["tienda_id", "parte", "banco_id"])
    with rocksdb_state(tx_stream.sparkSession):
        return (net_changes(net_events(tx_stream, ap_stream)).writeStream.foreachBatch(write).outputMode("update")
                .option("checkpointLocation", path + "/_checkpoint").trigger(**(trigger or CATCH_UP_TRIGGER)).start())


def current_net(spark: SparkSession, path: str) -> DataFrame:
    """(tienda_id, banco_id, neto_txn) after the last micro-batch."""
    parts = latest_snapshot(spark, path).filter("n > 0")
    cents = F.sum(F.col("centavos").cast("decimal(38,0)"))
    return parts.groupBy("tienda_id", "banco_id").agg((cents / 100).cast(MONEY_SQL).alias("neto_txn"))


def run_pending_changes(events: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """A change row (epoch, clase, pendientes, primer_id) whenever the
    number of open items of a class, or the head of its list, has changed after
    a micro-batch. ``events``: from ``pending_events``, any classes together.
    ``path`` gets ``data`` (versions of the parts' state) and ``changes``; a
    replayed batch writes the same rows again."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = totals(overlay(batch, epoch, f"{path}/data", ["clase", "parte"]))
        if epoch > 0:
            old = totals(spark.read.schema(batch.schema).parquet(f"{path}/data/lote={epoch - 1}")).select(
                F.col("clase").alias("_c"), F.col("pendientes").alias("_p"), F.col("primer_id").alias("_i"))
            now = now.join(old, now["clase"] == F.col("_c"), "left").filter(
                ~F.col("pendientes").eqNullSafe(F.col("_p")) | ~F.col("primer_id").eqNullSafe(F.col("_i")))
        now.select(F.lit(epoch).cast("long").alias("epoch"), "clase", "pendientes", "primer_id") \
           .write.mode("overwrite").parquet(f"{path}/changes/lote={epoch}")
    with rocksdb_state(events.sparkSession):
        return (pending_state(events).writeStream.foreachBatch(write).outputMode("update")
                .option("checkpointLocation", path + "/_checkpoint").trigger(**(trigger or CATCH_UP_TRIGGER)).start())


PARTIAL_SCHEMA = f"dia_inicio timestamp_ntz, tipo string, entrada {MONEY_SQL}, salida {MONEY_SQL}, ops long"
# The reference's live refresh is a 10-second poll.
LIVE_TRIGGER = {"processingTime": "10 seconds"}
CATCH_UP_TRIGGER = {"availableNow": True}


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version (``lote=<epoch>``) of the table that a stream writes
    to ``path``/data."""
    data = spark.read.parquet(path + "/data")
    return data.filter(F.col("lote") == data.agg(F.max("lote")).scalar()).drop("lote")
