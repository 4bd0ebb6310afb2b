"""The posting model: every write is a set of postings on account families
('tienda' store cash, 'banco' bank virtual balance, 'tesoreria' treasury
cash, 'deuda' advance debt). Balances are folds of postings (F5/F6).

Columns: ts, cuenta, tienda_id, banco_id, monto, tipo_asiento ('delta' adds,
'set' assigns), fuente (source table or command), fuente_id, orden (tie
order of sources at one instant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.breakdown import parse_breakdown
from tillbook.sources.schemas import MONEY_SQL

POSTING_COLUMNS = ["ts", "cuenta", "tienda_id", "banco_id", "monto", "tipo_asiento", "fuente",
                   "fuente_id", "orden"]


def posting(ts: Column | str, cuenta: str, tienda: Column | None, banco: Column | None, monto: Column,
            kind: str, fuente: str, fuente_id: Column | str, orden: int) -> list[Column]:
    """Select list of one posting leg."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return [c(ts).cast("timestamp_ntz").alias("ts"), F.lit(cuenta).alias("cuenta"),
            (tienda if tienda is not None else F.lit(None)).cast("long").alias("tienda_id"),
            (banco if banco is not None else F.lit(None)).cast("long").alias("banco_id"),
            monto.cast(MONEY_SQL).alias("monto"), F.lit(kind).alias("tipo_asiento"),
            F.lit(fuente).alias("fuente"), c(fuente_id).cast("long").alias("fuente_id"),
            F.lit(orden).alias("orden")]


def store_and_bank_legs(df: DataFrame, ts: str, cash: Column, bank: Column, fuente: str, fuente_id: str,
                        orden: int, zeros: bool = False) -> DataFrame:
    """Both legs of a transaction from one pass over ``df``: the store-cash
    leg always, the bank leg when the row has a bank and (unless ``zeros``) a
    non-zero bank amount (``explode`` of a one- or two-element array)."""
    store_leg = F.struct(F.lit("tienda").alias("cuenta"), F.lit(None).cast("long").alias("b"),
                         cash.cast(MONEY_SQL).alias("m"))
    bank_leg = F.struct(F.lit("banco").alias("cuenta"), F.col("banco_id").cast("long").alias("b"),
                        bank.cast(MONEY_SQL).alias("m"))
    has_bank = F.col("banco_id").isNotNull()
    if not zeros:
        has_bank = has_bank & (bank != 0)
    legs = F.when(has_bank, F.array(store_leg, bank_leg)).otherwise(F.array(store_leg))
    e = df.select(F.col(ts).cast("timestamp_ntz").alias("ts"), F.col("tienda_id").cast("long").alias("tienda_id"),
                  F.col(fuente_id).cast("long").alias("fuente_id"), F.explode(legs).alias("_l"))
    return e.select("ts", F.col("_l.cuenta").alias("cuenta"), "tienda_id", F.col("_l.b").alias("banco_id"),
                    F.col("_l.m").alias("monto"), F.lit("delta").alias("tipo_asiento"), F.lit(fuente).alias("fuente"),
                    "fuente_id", F.lit(orden).alias("orden"))


def store_cash_postings(L) -> DataFrame:
    """Store cash: openings set the cash, transactions add to it, closings set
    it to the carry-over max(0, declared - delivered)."""
    ap = L["aperturas_caja"].select(*posting("fecha_hora", "tienda", F.col("tienda_id"), None,
                                             F.col("saldo_inicial_efectivo"), "set", "apertura", "id", 0))
    tx = L["transacciones"].select(*posting("fecha_hora", "tienda", F.col("tienda_id"), None,
                                            F.col("monto_efectivo"), "delta", "transaccion", "id", 1))
    ci = parse_breakdown(L["cierres_caja"])
    carry = F.greatest(F.col("saldo_real") - F.col("total_entregado"), F.lit(0).cast(MONEY_SQL))
    ci = ci.select(*posting("fecha", "tienda", F.col("tienda_id"), None, carry, "set", "cierre", "id", 2))
    return ap.unionByName(tx).unionByName(ci)


def bank_postings(L) -> DataFrame:
    """Bank virtual balance: the balance row sets the balance at its update
    time, transactions with a bank add their bank leg."""
    s = L["saldos_bancarios"].select(*posting("actualizado_en", "banco", None, F.col("banco_id"),
                                              F.col("saldo"), "set", "saldo", "banco_id", 0))
    tx = L["transacciones"].filter(F.col("banco_id").isNotNull()).select(
        *posting("fecha_hora", "banco", F.col("tienda_id"), F.col("banco_id"), F.col("monto_banco"),
                 "delta", "transaccion", "id", 1))
    return s.unionByName(tx)
