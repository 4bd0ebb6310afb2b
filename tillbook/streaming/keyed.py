"""Keyed state of the streams: net cash that an opening resets, and sets of
pending items from which receipts take away.

State lies in RocksDB (checkpointed with the stream). Net cash is looked up
point by point; pending items lie packed in many small parts, each folded with
its new rows at once, so a micro-batch costs what it brings and the parts that
it touches. Results are versions of a small table
(``lote=<epoch>``): a batch reads only the version before it and overlays its
changes; a replayed batch writes the same version again.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# the processors travel by value: executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# a store's or a kind's state is split into so many keys, so a hot one is not one task
PARTS = 8
NO_TIME = -(1 << 63)
NET_SCHEMA = "tienda_id long, parte int, banco_id long, centavos long, n long"
# pending items lie in so many parts of a class; a micro-batch reads and writes those that its items are in
PENDING_PARTS = 4096
# rows of a part that are folded at once
FOLD_ROWS = 100_000
PENDING_SCHEMA = "clase string, parte int, pendientes long, fecha long, primer_id long"
PENDING_STATE = "pendientes long, fecha long, primer_id long, abiertos binary, fechas binary, cerrados binary"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class NetSinceOpening(StatefulProcessor):
    """Per store (and part): cents and number of transactions per bank since
    the latest opening. Transactions at or after it are kept with their time,
    since an opening that arrives later may lie between them; it drops those
    before it. Without an opening there is no net, but transactions wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "ts bigint")
        self.kept = handle.getListState("kept", "ts bigint, banco string, centavos bigint, n bigint")
        self.net = handle.getMapState("net", "banco string", "centavos bigint, n bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        opening, fresh = None, {}
        for r in rows:
            if r.apertura:
                opening = r.ts if opening is None else max(opening, r.ts)
            else:
                both = fresh.setdefault((r.ts, "" if r.banco_id is None else str(r.banco_id)), [0, 0])
                both[0] += r.centavos
                both[1] += 1
        before = self.opened.get()[0] if self.opened.exists() else None
        now = opening if before is None else before if opening is None else max(before, opening)
        entries = [(ts, bank, cents, n) for (ts, bank), (cents, n) in fresh.items() if now is None or ts >= now]
        if now != before:
            self.opened.update((now,))
            entries += [tuple(e) for e in (self.kept.get() if self.kept.exists() else ()) if e[0] >= now]
            if entries:
                self.kept.put(entries)
            else:
                self.kept.clear()
            touched = {k[0]: (0, 0) for k in (list(self.net.keys()) if self.net.exists() else ())}
            self.net.clear()
        else:
            if entries:
                self.kept.appendList(entries)
            touched = {}
        if now is None:
            return
        for _, bank, cents, n in entries:
            if bank not in touched:
                touched[bank] = tuple(self.net.getValue((bank,))) if self.net.containsKey((bank,)) else (0, 0)
            touched[bank] = (touched[bank][0] + cents, touched[bank][1] + n)
        for bank, (cents, n) in touched.items():
            if n:
                self.net.updateValue((bank,), (cents, n))
            yield Row(tienda_id=key[0], parte=key[1], banco_id=int(bank) if bank else None, centavos=cents, n=n)

    def close(self) -> None:
        pass


def longs(packed: bytes | None) -> np.ndarray:
    """The numbers of a packed column of the state."""
    return np.frombuffer(bytes(packed or b""), dtype="<i8")


def one_row_an_item(ids: np.ndarray, ts: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events in their order, reduced to one per id: the last time that one of
    them names, and whether any of them closes the item."""
    by_id = np.argsort(ids, kind="stable")
    ids, ts, closed = ids[by_id], ts[by_id], closed[by_id]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    named = np.maximum.reduceat(np.where(ts != NO_TIME, np.arange(len(ts)), -1), first)
    return ids[first], np.where(named >= 0, ts[named], NO_TIME), np.logical_or.reduceat(closed, first)


def pending_set(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per class and part: which items are open, and the head (latest time,
    then id). An item opens when it is sent and closes for good with its
    receipt, in whatever order the two arrive; of its times the one delivered
    last counts. The rows are folded with the part's items in stretches, so an
    item delivered any number of times takes no more memory than one stretch."""
    start, kept = None, (None, None, None)
    if state.exists:
        (*start, _, _, _), kept = state.get, state.get[3:]
    open_ids, times, closed_ids = map(longs, kept)
    items = (np.concatenate([closed_ids, open_ids]), np.concatenate([np.full(len(closed_ids), NO_TIME), times]),
             np.arange(len(closed_ids) + len(open_ids)) < len(closed_ids))
    waiting, n = [], 0
    for f in frames:
        waiting.append((f["id"].to_numpy("int64"), f["ts"].to_numpy("int64"), ~f["abierto"].to_numpy(bool)))
        n += len(f)
        if n >= max(FOLD_ROWS, len(items[0])):
            items, waiting, n = one_row_an_item(*map(np.concatenate, zip(items, *waiting))), [], 0
    if n:
        items = one_row_an_item(*map(np.concatenate, zip(items, *waiting)))
    ids, ts, closed = items
    open_ids, times = ids[~closed], ts[~closed]
    end = [len(open_ids), None, None]
    if len(open_ids):
        head = np.lexsort((open_ids, times))[-1]
        end[1:] = int(times[head]), int(open_ids[head])
    state.update((*end, *(x.astype("<i8").tobytes() for x in (open_ids, times, ids[closed]))))
    if end != start:
        yield pd.DataFrame({"clase": [key[0]], "parte": [key[1]], "pendientes": end[:1],
                            "fecha": pd.array(end[1:2], "Int64"), "primer_id": pd.array(end[2:], "Int64")})


def instant(wall) -> "F.Column":
    """Microseconds of a wall time read as UTC."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall.cast("timestamp_ntz")).cast("timestamp"))


def net_events(tx_stream: DataFrame, ap_stream: DataFrame) -> DataFrame:
    """Transactions (a part each, by id) and openings (all parts) as one
    stream of events. Null amounts count as nothing; rows without a time do
    not take part, as in the dashboard's comparison with the opening."""
    tx = tx_stream.select("tienda_id", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("parte"),
                          instant(F.col("fecha_hora")).alias("ts"), "banco_id",
                          F.coalesce((F.col("monto_efectivo") * 100).cast("long"), F.lit(0).cast("long")).alias("centavos"),
                          F.lit(False).alias("apertura"))
    ap = ap_stream.select("tienda_id", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("parte"),
                          instant(F.col("fecha_hora")).alias("ts"), F.lit(None).cast("long").alias("banco_id"),
                          F.lit(0).cast("long").alias("centavos"), F.lit(True).alias("apertura"))
    return tx.unionByName(ap).filter("tienda_id is not null and ts is not null")


def net_changes(events: DataFrame) -> DataFrame:
    """The parts' nets that a micro-batch changes (``n`` = 0: gone)."""
    return events.groupBy("tienda_id", "parte").transformWithState(NetSinceOpening(), NET_SCHEMA, "Update", "None")


def pending_events(rows: DataFrame, clase: str, ts: str, closed: bool = True) -> DataFrame:
    """Events of a table whose rows come when an item is sent (estado
    'Pendiente') and, again, when it is received or paid (any other). With
    ``closed`` a row that is no longer pending stands for both events."""
    open_ = F.coalesce(F.col("estado") == "Pendiente", F.lit(False))
    both = F.when(open_, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)) if closed else F.array(F.lit(False)))
    return rows.filter("id is not null").select(
        F.lit(clase).alias("clase"), F.pmod(F.xxhash64("id"), F.lit(PENDING_PARTS)).cast("int").alias("parte"), "id",
        instant(F.col(ts)).alias("ts"), F.explode(both).alias("abierto"))


def pending_state(events: DataFrame) -> DataFrame:
    """The parts' numbers of open items and heads that a micro-batch changes."""
    timed = events.withColumn("ts", F.coalesce("ts", F.lit(NO_TIME)))
    return timed.groupBy("clase", "parte").applyInPandasWithState(
        pending_set, PENDING_SCHEMA, PENDING_STATE, "update", GroupStateTimeout.NoTimeout)


def overlay(batch: DataFrame, epoch: int, path: str, keys: list[str]) -> DataFrame:
    """Version ``epoch`` of the table at ``path``: the version before it with
    the batch's rows in place of those of the same keys."""
    spark = batch.sparkSession
    new = batch
    if epoch > 0:
        old = spark.read.schema(batch.schema).parquet(f"{path}/lote={epoch - 1}").alias("o")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        new = batch.unionByName(old.join(batch.select(*keys).alias("n"), same, "left_anti"))
    new.write.mode("overwrite").parquet(f"{path}/lote={epoch}")
    return spark.read.schema(batch.schema).parquet(f"{path}/lote={epoch}")


def totals(parts: DataFrame) -> DataFrame:
    """(clase, pendientes, primer_id) over the parts."""
    head = F.max(F.when(F.col("primer_id").isNotNull(), F.struct("fecha", "primer_id")))
    return parts.groupBy("clase").agg(F.sum("pendientes").alias("pendientes"), head["primer_id"].alias("primer_id"))
