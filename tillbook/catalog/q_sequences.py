"""Jobs whose command frame names every target twice: the base commands and a
later copy of each. Oracles follow the rule of the job for the second command
(nothing more happens, or the later one stands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.catalog import ORACLES, register
from tillbook.catalog.q_posting import GASTO_EDITS_SQL
from tillbook.operators import posting as I
from tillbook.sources.store import StoredLedger as Ledger


def and_later(cmds: DataFrame, ts: str, hours: int = 1, **changes) -> DataFrame:
    """``cmds`` and a copy of each some hours later, with changed columns."""
    later = cmds.withColumn(ts, F.col(ts) + F.make_dt_interval(hours=F.lit(hours)))
    for name, value in changes.items():
        later = later.withColumn(name, value.cast(cmds.schema[name].dataType))
    return cmds.unionByName(later)


def after(ts: str, hours: int):
    return (F.col(ts) + F.make_dt_interval(hours=F.lit(hours))).alias("ts")


@register("i5_receive_remits_repeated", ORACLES["i5_receive_remits"].replace("INTERVAL 2 HOUR", "INTERVAL 3 HOUR")
          .replace("CAST(0 AS BIGINT) ELSE usuario_recibe_id", "CAST(1 AS BIGINT) ELSE usuario_recibe_id"), raw_sql=True)
def i5_repeated(spark, d):
    """The last receipt of a remittance stands."""
    rem = Ledger(spark, d)["remesas"]
    cmds = rem.filter(F.col("estado") == "Pendiente").select(
        F.col("id").alias("remesa_id"), after("fecha_envio", 2).alias("fecha"), F.lit(0).cast("long").alias("usuario_id"))
    return I.receive_remits(rem, and_later(cmds, "fecha", usuario_id=F.lit(1)))


@register("i10_pay_advances_repeated", ORACLES["i10_pay_advances"], raw_sql=True)
def i10_repeated(spark, d):
    """A debt is paid once."""
    dep = Ledger(spark, d)["depositos_adelantados"]
    cmds = dep.select(F.col("id").alias("deposito_id"), after("fecha_hora", 30 * 24))
    return I.pay_advances(dep, and_later(cmds, "ts"))["log"]


@register("i19_reverse_transactions_repeated", ORACLES["i19_reverse_transactions"], raw_sql=True)
def i19_repeated(spark, d):
    """A transaction is undone once."""
    tx = Ledger(spark, d)["transacciones"]
    ids = tx.filter(F.col("tipo") == "Retiro").select("id")
    return I.reverse_transactions(tx, ids.unionByName(ids))["postings"]


@register("i25_reverse_debts_repeated", ORACLES["i25_reverse_debts"], raw_sql=True)
def i25_repeated(spark, d):
    """A debt is dropped once."""
    dep = Ledger(spark, d)["depositos_adelantados"]
    cmds = dep.filter(F.col("estado") == "Pendiente").select(
        F.col("id").alias("deposito_id"), (F.col("banco_id") % 2 == 0).alias("revertir"), after("fecha_hora", 24))
    return I.reverse_debts(dep, and_later(cmds, "ts"))["postings"]


@register("i2_repost_transactions_repeated", "SELECT fuente_id, cuenta, tienda_id, banco_id, monto FROM ("
          + ORACLES["i2_repost_transactions"].replace("(c.monto + 1)", "(c.monto + 2)") + ") twice", raw_sql=True)
def i2_repeated(spark, d):
    """Two edits of each transaction: together they move the account from the
    stored amount to that of the second edit."""
    L = Ledger(spark, d)
    edits = L.commands().select("id", (F.col("monto") + 1).cast("decimal(18,2)").alias("monto"), "referencia",
                                after("fecha_hora", 24))
    twice = and_later(edits, "ts", monto=F.col("monto") + 1)
    p = I.repost_transactions(L["transacciones"], twice, L["comisiones"])["postings"]
    return p.groupBy("fuente_id", "cuenta", "tienda_id", "banco_id").agg(F.sum("monto").cast("decimal(18,2)").alias("monto"))


@register("i20_adjust_expenses_repeated", """
SELECT g.id AS fuente_id, CAST(g.monto - ifnull(e.nuevo - 1, 0) AS DECIMAL(18,2)) AS monto
FROM gastos g JOIN gedits e ON e.id = g.id""", extra_ctes=GASTO_EDITS_SQL)
def i20_repeated(spark, d):
    """A second edit starts from the first; after a delete nothing happens."""
    g = Ledger(spark, d)["gastos"]
    edits = g.filter(F.col("categoria").isin("Servicios", "Papelería")).select(
        "id", F.when(F.col("categoria") == "Servicios", (F.col("monto") - 10).cast("decimal(18,2)")).alias("monto"),
        after("fecha_hora", 24))
    p = I.adjust_expenses(g, and_later(edits, "ts", monto=F.col("monto") - 1))["postings"]
    return p.groupBy("fuente_id").agg(F.sum("monto").cast("decimal(18,2)").alias("monto"))
