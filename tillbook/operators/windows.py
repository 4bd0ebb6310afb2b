"""Group F: latest rows, ordering, top-k and resettable running balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.operators.joins import asof_opening
from tillbook.operators.scans import RANGE, dealt_by_range, with_carry, within_range
from tillbook.sources.schemas import MONEY_SQL

# The base used when no treasury snapshot exists.
NO_SNAPSHOT_TS = "1970-01-01 00:00:00"


def latest_by_id(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """the row with the max id per key, as an aggregate (``max_by``) so it
    is combined map-side; a hot key costs one row per task in the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.col(id_col)).alias("_r")).select("_r.*")


def latest_opening_ts(ap: DataFrame) -> DataFrame:
    """max opening time per store (may differ from the max-id opening)."""
    return ap.groupBy("tienda_id").agg(F.max("fecha_hora").alias("ultima_apertura"))


def last_treasury_closing(ct: DataFrame) -> DataFrame:
    """newest treasury snapshot (time, then id); none -> 1970 with '{}'.
    Always one row."""
    row = F.struct("fecha_hora", "id", "saldos_json")
    agg = ct.agg(F.max(row).alias("_r"))
    return agg.select(F.col("_r.id").alias("id"),
                      F.coalesce(F.col("_r.fecha_hora"), F.lit(NO_SNAPSHOT_TS).cast("timestamp_ntz"))
                      .alias("fecha_hora"),
                      F.coalesce(F.col("_r.saldos_json"), F.lit("{}")).alias("saldos_json"))


def history_top_n(hist: DataFrame, n: int = 100) -> DataFrame:
    """newest ``n`` rows of a history (a total order: time, then the
    remaining columns), planned as TakeOrderedAndProject (per-task top-n, then
    a merge of n rows per task)."""
    order = [F.col("fecha").desc_nulls_last(), F.col("source_table"), F.col("log_id").desc_nulls_last(),
             F.col("monto").desc(), F.col("origen"), F.col("ref")]
    return hist.orderBy(*order).limit(n)


def running_balance(postings: DataFrame, keys: list[str], ts: str = "ts", order: list[str] | None = None,
                    amount: str = "amount", kind: str = "kind", out: str = "saldo") -> DataFrame:
    """balance after every posting; a ``set`` posting assigns the
    balance, a ``delta`` posting adds to it.

    A segmented scan over ranges of (account, time, tie), see ``scans``:
    1. inside each range and account: segment = running count of sets, running
       sum inside the segment;
    2. each range is reduced to its carry (the sum after its last set, or its
       whole sum where it has none), and carries are chained over the ranges of
       an account in the same way;
    3. rows before the first set of their range add the carry of the ranges
       before it."""
    ordering = [ts, *(order or [])]
    p = dealt_by_range(postings, keys, ordering).withColumn("_is_set", (F.col(kind) == "set").cast("int"))
    p = p.withColumn("_lseg", F.sum("_is_set").over(within_range(keys, ordering)))
    p = p.withColumn("_run", F.sum(F.col(amount)).over(within_range(keys, ordering, "_lseg")))
    # the last row of a range and account holds its number of sets and its sum
    # after the last of them
    ends = p.groupBy(RANGE, *keys).agg(F.max_by(F.struct("_lseg", "_run"), F.struct(*ordering)).alias("_end"))
    chain = W.partitionBy(*keys).orderBy(RANGE)
    so_far = chain.rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = ends.withColumn("_seg2", F.sum((F.col("_end._lseg") > 0).cast("int")).over(so_far))
    ends = ends.withColumn("_cout", F.sum("_end._run").over(
        W.partitionBy(*keys, "_seg2").orderBy(RANGE).rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = ends.withColumn("_cin", F.lag("_cout", 1).over(chain))
    j = with_carry(p, ends, keys, {"_cin": F.col("_cin")})
    bal = F.when(F.col("_lseg") > 0, F.col("_run")).otherwise(F.coalesce("_cin", F.lit(0)) + F.col("_run"))
    return j.withColumn(out, bal.cast(MONEY_SQL)).drop(RANGE, "_is_set", "_lseg", "_run", "_cin")


def running_store_cash(postings: DataFrame) -> DataFrame:
    """store cash after each posting (family 'tienda')."""
    p = postings.filter(F.col("cuenta") == "tienda")
    return running_balance(p, ["tienda_id"], "ts", ["orden", "fuente_id"], "monto", "tipo_asiento")


def running_bank_balance(postings: DataFrame) -> DataFrame:
    """bank virtual balance after each posting (family 'banco')."""
    p = postings.filter(F.col("cuenta") == "banco")
    return running_balance(p, ["banco_id"], "ts", ["orden", "fuente_id"], "monto", "tipo_asiento")


def shift_bounds(ap: DataFrame, ci: DataFrame) -> DataFrame:
    """every closing with its shift start (as-of opening) and end."""
    j = asof_opening(ci, ap)
    return j.select(F.col("id").alias("cierre_id"), "tienda_id", "apertura_id", "desde",
                    F.col("fecha").alias("hasta"), "saldo_inicial_ef")


def sorted_listing(df: DataFrame, cols: list, ascending: bool = True) -> DataFrame:
    """F8: sorted listings (range-partitioned sort at scale)."""
    return df.orderBy(*cols, ascending=ascending)


def current_balance(running: DataFrame, keys: list[str], ts: str = "ts", order: list[str] | None = None,
                    out: str = "saldo") -> DataFrame:
    """Current balance per account: the running balance after its last
    posting (``max_by`` aggregate, combined map-side)."""
    order = order or []
    last = F.struct(F.col(ts), *[F.col(c) for c in order])
    return running.groupBy(*keys).agg(F.max_by(F.col(out), last).alias(out))
