"""Group G: set operations (UNION ALL and DISTINCT only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.timeparse import business_day

# Labels of the treasury history.
RECEIVED_LABEL = "Remesa Recibida"
GENERAL_FUND = "Fondo General"
LOOSE_CASH = "Otros/Suelto"
PACKAGE_MARK = " (📦 "
ARROW_MARK = " ➔ "


def treasury_history(rem: DataFrame, log: DataFrame, tiendas: DataFrame, bancos: DataFrame,
                     day: str | None = None, tz: str | None = None) -> DataFrame:
    """G1: received remittances UNION ALL treasury log rows (of one business
    day, or all days when ``day`` is None), with origin labels."""
    t = tiendas.select(F.col("id").alias("_tid"), F.col("nombre").alias("_tn"))
    b = bancos.select(F.col("id").alias("_bid"), F.col("nombre").alias("_bn"))
    r = rem.filter(F.col("estado") == "Recibido")
    if day is not None:
        r = r.filter(business_day("fecha_recepcion", tz) == F.lit(day).cast("date"))
    r = (r.join(t, r.tienda_id == t._tid, "inner").join(b, r.banco_id == b._bid, "left")
          .select(F.lit(RECEIVED_LABEL).alias("tipo_trans"), F.col("id").alias("log_id"), "monto",
                  F.col("fecha_recepcion").alias("fecha"),
                  F.concat(F.col("_tn"), F.lit(PACKAGE_MARK), F.coalesce("_bn", F.lit(GENERAL_FUND)),
                           F.lit(")")).alias("origen"),
                  F.lit("Efectivo").alias("via"), F.col("observaciones").alias("ref"),
                  F.lit("remesa").alias("source_table")))
    lg = log if day is None else log.filter(business_day("fecha_hora", tz) == F.lit(day).cast("date"))
    b2 = b.select(F.col("_bid").alias("_bid2"), F.col("_bn").alias("_bn2"))
    lg = (lg.join(b, lg.banco_id == b._bid, "left").join(b2, lg.banco_destino_id == b2._bid2, "left")
            .select(F.col("tipo").alias("tipo_trans"), F.col("id").alias("log_id"), "monto",
                    F.col("fecha_hora").alias("fecha"),
                    F.concat(F.coalesce("_bn", F.lit(LOOSE_CASH)),
                             F.when(F.col("banco_destino_id").isNotNull(),
                                    F.concat(F.lit(ARROW_MARK), F.col("_bn2"))).otherwise(F.lit("")))
                    .alias("origen"),
                    F.lit("Banco").alias("via"), F.col("referencia").alias("ref"),
                    F.lit("tesoreria_log").alias("source_table")))
    return r.unionByName(lg)


def append_treasury_row(matrix: DataFrame, teso: DataFrame) -> DataFrame:
    """The treasury row appended to the store matrix (same columns)."""
    return matrix.unionByName(teso.select(*matrix.columns))


def append_otros(banks: DataFrame, otros: DataFrame, amount_col: str, only_nonzero: bool = False) -> DataFrame:
    """The 'Otros' row appended to the bank rows (same columns); with
    ``only_nonzero`` only if its amount is not 0."""
    extra = otros.filter(F.col(amount_col) != 0) if only_nonzero else otros
    return banks.unionByName(extra.select(*banks.columns))
