"""Reversals (I18, I23, I24): undo postings of earlier writes and drop the
reversed rows (left anti joins); matches to the rows a write created use the
tolerance of D18, one to one or reduced per amount, never as pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.functions.timeparse import business_day
from tillbook.operators.commands import one_per_target
from tillbook.operators.joins import band_join
from tillbook.operators.postings import posting
from tillbook.sources.schemas import MONEY_SQL

# Tolerance of the send match and the restock type.
SEND_MATCH_TOL = 0.1
RESTOCK_TYPE = "Resurtido Tesorería"


def reverse_treasury_log(log: DataFrame, ids: DataFrame, tx: DataFrame, ts_col: str = "ts",
                         compat: bool = False) -> dict[str, DataFrame]:
    """Per-type undo of the named log rows (``ids``: id, ts [, revertir];
    without ``revertir`` only the log row is dropped):
    Gasto Bancario -> bank +m; Depósito a Banco -> target bank -m; transfers
    -> bank -m only when the transfer added it (log column ``afecta_banco``;
    with ``compat=True`` or without that column, as the source does: bank -m
    for every transfer row); Envío a Tienda -> its restock transaction: store
    cash -m (the log's amount) and the transaction is dropped. Each send takes
    a restock of its own, of the same hour and any store: first those of equal
    amount are paired one to one in id order, then what is left over of nearly
    equal amount (|diff| < 0.1), until no such pair is left. ``ambiguos`` lists sends with
    more than one candidate within the tolerance. The log rows are dropped; an
    id named more than once is reversed once. ``transacciones``: ``tx``
    without the restocks taken."""
    rev = F.coalesce(F.col("revertir"), F.lit(True)) if "revertir" in ids.columns else F.lit(True)
    i = one_per_target(ids.select(F.col("id").alias("_rid"), F.col(ts_col).alias("_ts"), rev.alias("_rev")), "_rid", "_ts")
    kept = log.join(i, log.id == i._rid, "left_anti")
    hit = log.join(i, log.id == i._rid, "inner").filter("_rev")
    t = F.col("tipo")
    m = F.col("monto")
    transfer = t.isin("Traslado (Efectivo)", "Traslado (Solo Saldo)")
    if not compat and "afecta_banco" in log.columns:
        transfer = transfer & F.coalesce(F.col("afecta_banco"), F.lit(True))
    bank = (F.when(t == "Gasto Bancario", F.col("banco_id")).when(t == "Depósito a Banco", F.col("banco_destino_id"))
            .when(transfer, F.col("banco_id")))
    amount = F.when(t == "Gasto Bancario", m).otherwise(-m)
    p_bank = hit.filter(bank.isNotNull()).select(
        *posting("_ts", "banco", None, bank, amount, "delta", "reverso_tesoreria", "id", 3))
    sends = hit.filter(t == "Envío a Tienda").select("id", "monto", "fecha_hora", "_ts")
    restock = tx.filter(F.col("tipo") == RESTOCK_TYPE).select("id", "tienda_id", F.col("monto_efectivo").alias("monto"),
                                                              "fecha_hora")
    # candidates per amount, counted on distinct amounts
    per = lambda df, n: df.groupBy(F.date_trunc("hour", "fecha_hora").alias("_hr"), F.col("monto").alias("_am")) \
        .agg(F.count(F.lit(1)).alias(n))
    width = F.lit(SEND_MATCH_TOL).cast("decimal(18,6)")
    counts = (band_join(per(sends, "_sends").drop("_sends"), per(restock, "_n"), ["_hr"], width, SEND_MATCH_TOL)
              .groupBy("_hr", "_am").agg(F.sum("_n").alias("candidatos")).filter("candidatos > 1"))
    ambiguous = sends.join(counts, (F.date_trunc("hour", sends.fecha_hora) == counts._hr) & (sends.monto == counts._am)) \
                     .select(F.col("id").alias("log_id"), "candidatos")
    exact = pair_in_order(sends, restock, F.col("monto"))
    left_s = sends.join(exact, sends.id == exact.log_id, "left_anti")
    left_r = restock.join(exact, restock.id == exact.transaccion_id, "left_anti")
    near = pair_within_tolerance(left_s, left_r)
    mt = exact.unionByName(near)
    p_store = mt.select(*posting("_ts", "tienda", F.col("m_tienda_id"), None, (-F.col("monto")).cast(MONEY_SQL),
                                 "delta", "reverso_tesoreria", "log_id", 3))
    matched = mt.select("log_id", "transaccion_id")
    rest = tx.join(matched.select(F.col("transaccion_id").alias("_t")), tx.id == F.col("_t"), "left_anti")
    return {"postings": p_bank.unionByName(p_store), "matched": matched, "log": kept, "ambiguos": ambiguous,
            "transacciones": rest}


def pair_in_order(sends: DataFrame, restock: DataFrame, amount) -> DataFrame:
    """Pairs the n-th send with the n-th restock (by id) of the same hour and
    ``amount`` value: one to one, so the result is no larger than the input."""
    nth = F.row_number().over(W.partitionBy("_hr", "_am").orderBy("id"))
    hour = F.date_trunc("hour", "fecha_hora").alias("_hr")
    a = sends.select(F.col("id"), "monto", "_ts", hour, amount.alias("_am")).withColumn("_n", nth)
    b = restock.select("id", "tienda_id", "monto", hour, amount.alias("_am")).withColumn("_n", nth) \
               .select("_hr", "_am", "_n", F.col("id").alias("transaccion_id"), F.col("tienda_id").alias("m_tienda_id"),
                       F.col("monto").alias("m_monto"))
    return a.join(b, ["_hr", "_am", "_n"], "inner").select(F.col("id").alias("log_id"), "monto", "_ts", "transaccion_id",
                                                           "m_tienda_id", "m_monto")


def pair_within_tolerance(sends: DataFrame, restock: DataFrame) -> DataFrame:
    """Pairs sends and restocks of the same hour whose amounts differ by less
    than ``SEND_MATCH_TOL``, one to one, until no such pair is left. A pass
    pairs the n-th with the n-th (by id) of each step of that width; passes
    shift the step edges by a cent each, so that any two amounts within the
    tolerance are in one step once. A pass adds windows only, so the plan grows
    with the number of passes."""
    cents = round(SEND_MATCH_TOL * 100)
    hour = F.date_trunc("hour", "fecha_hora").alias("_hr")
    none = F.lit(None).cast("bigint")
    u = sends.select(hour, F.lit(True).alias("_send"), "id", "monto", "_ts", none.alias("tienda_id")).unionByName(
        restock.select(hour, F.lit(False).alias("_send"), "id", "monto", F.lit(None).cast(sends.schema["_ts"].dataType).alias("_ts"),
                       F.col("tienda_id").cast("bigint").alias("tienda_id")))
    u = u.withColumns({"_pass": F.lit(None).cast("int"), "_step": none, "_n": none})
    for shift in range(cents):
        u = u.withColumns({"_open": F.col("_pass").isNull(), "_s": F.floor((F.col("monto") * 100 + shift) / cents).cast("bigint")})
        here = W.partitionBy("_hr", "_s", "_open")
        u = u.withColumns({"_r": F.row_number().over(W.partitionBy("_hr", "_s", "_open", "_send").orderBy("id")).cast("bigint"),
                           "_most": F.least(F.count_if("_send").over(here), F.count_if(~F.col("_send")).over(here))})
        hit = F.col("_open") & (F.col("_r") <= F.col("_most"))
        u = u.withColumns({"_pass": F.when(hit, F.lit(shift)).otherwise(F.col("_pass")),
                           "_step": F.when(hit, F.col("_s")).otherwise(F.col("_step")),
                           "_n": F.when(hit, F.col("_r")).otherwise(F.col("_n"))})
    key = ["_hr", "_pass", "_step", "_n"]
    b = u.filter(~F.col("_send")).select(*key, F.col("id").alias("transaccion_id"), F.col("tienda_id").alias("m_tienda_id"),
                                         F.col("monto").alias("m_monto"))
    return u.filter("_send").drop("tienda_id").join(b, key, "inner").select(
        F.col("id").alias("log_id"), "monto", "_ts", "transaccion_id", "m_tienda_id", "m_monto")


def reverse_remits(rem: DataFrame, cmds: DataFrame, tx: DataFrame) -> dict[str, DataFrame]:
    """Drop remittances (``cmds``: remesa_id, revertir, ts); with
    ``revertir`` the cash goes back to the store (+m) and every handover
    transaction of the same store and hour whose cash is minus the amount
    (|diff| < 0.01, that is equal cents) is dropped. ``matched``: one row per
    dropped transaction with the first reversal that meets it (command time,
    then id); ``transacciones``: those that stay. The first command on a
    remittance drops it."""
    c = one_per_target(cmds.select("remesa_id", "ts", "revertir"), "remesa_id", "ts").select(
        F.col("remesa_id").alias("_rid"), F.col("revertir").alias("_rev"), F.col("ts").alias("_ts"))
    hit = rem.join(c, rem.id == c._rid, "inner")
    rev = hit.filter("_rev")
    p = rev.select(*posting("_ts", "tienda", F.col("tienda_id"), None, F.col("monto"), "delta", "reverso_remesa", "id", 3))
    taken = (rev.groupBy(F.col("tienda_id").alias("_t"), F.date_trunc("hour", "fecha_envio").alias("_hr"),
                         F.col("monto").alias("_am"))
                .agg(F.min(F.struct("_ts", "id"))["id"].alias("remesa_id")))
    hand = tx.filter(F.col("tipo") == "Efectivo Entregado").select(
        F.col("id").alias("transaccion_id"), F.col("tienda_id").alias("_t"),
        F.date_trunc("hour", "fecha_hora").alias("_hr"), (-F.col("monto_efectivo")).cast(MONEY_SQL).alias("_am"))
    matched = hand.join(taken, ["_t", "_hr", "_am"], "inner").select("remesa_id", "transaccion_id")
    rest = tx.join(matched.select(F.col("transaccion_id").alias("_x")), tx.id == F.col("_x"), "left_anti")
    kept = rem.join(c, rem.id == c._rid, "left_anti")
    return {"postings": p, "matched": matched, "remesas": kept, "transacciones": rest}


def reverse_closings(ci: DataFrame, ap: DataFrame, rem: DataFrame, cmds: DataFrame, tz: str | None = None) -> dict[str, DataFrame]:
    """Undo closings (``cmds``: cierre_id, ts): store cash := the
    closing's theoretical balance (a ``set`` posting), the store's latest
    closed opening is reopened, the closing is dropped, and the store's
    Pendiente remittances sent on the command's day are dropped. With several
    closings of a store the n-th reversal finds the n-th latest closed opening
    (those before it are open again by then). ``tz``: zone of the day where
    times are UTC instants. ``aperturas`` and ``remesas``:
    the tables after the reversal."""
    c = one_per_target(cmds.select("cierre_id", "ts"), "cierre_id", "ts").select(
        F.col("cierre_id").alias("_cid"), F.col("ts").alias("_ts"))
    hit = ci.join(c, ci.id == c._cid, "inner")
    p = hit.select(*posting("_ts", "tienda", F.col("tienda_id"), None, F.col("saldo_teorico"), "set",
                            "reverso_cierre", "id", 3))
    per_store = hit.groupBy(F.col("tienda_id").alias("_st")).agg(F.count(F.lit(1)).alias("_closings"))
    closed = ap.filter(F.col("estado") == "Cerrada").select(
        "tienda_id", F.col("id").alias("apertura_id"),
        F.row_number().over(W.partitionBy("tienda_id").orderBy(F.desc("id"))).alias("_n"))
    reopen = (closed.join(per_store, closed.tienda_id == per_store._st, "inner").filter("_n <= _closings")
              .select("tienda_id", "apertura_id"))
    again = reopen.select(F.col("apertura_id").alias("_again"))
    openings = ap.join(again, ap.id == F.col("_again"), "left").select(
        *[F.when(F.col("_again").isNotNull(), F.lit("Abierta")).otherwise(F.col(x)).alias(x) if x == "estado" else F.col(x)
          for x in ap.columns])
    days = hit.select(F.col("tienda_id").alias("_st"), business_day("_ts", tz).alias("_day")).distinct()
    sent = (rem.estado == "Pendiente") & (rem.tienda_id == days._st) & (business_day(rem.fecha_envio, tz) == days._day)
    kept_ci = ci.join(c, ci.id == c._cid, "left_anti")
    return {"postings": p, "reabrir": reopen, "remesas_eliminadas": rem.join(days, sent, "left_semi"), "cierres": kept_ci,
            "aperturas": openings, "remesas": rem.join(days, sent, "left_anti")}
