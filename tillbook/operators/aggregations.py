"""Group E: aggregations. All are groupBy/agg with map-side partial
aggregation; only one row per group and task crosses the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.balances import balance_map, map_total
from tillbook.functions.timeparse import business_day
from tillbook.operators.joins import flow_terms, join_nullsafe, since_opening
from tillbook.operators.scans import interval_sums
from tillbook.sources.schemas import MONEY_SQL

def zero():
    """decimal(18,2) zero."""
    return F.lit(0).cast(MONEY_SQL)




def msum(c: Column | str) -> Column:
    """Money sum cast back to decimal(18,2)."""
    return F.sum(c).cast(MONEY_SQL)


def msum0(c: Column | str) -> Column:
    """Money sum where SQL NULL (no rows) reads as 0 (``|| 0`` on the JS side)."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SQL)


# totals over all stores, banks or times: wider than one amount
TOTAL_SQL = "decimal(38,2)"


def mtotal(c: Column | str) -> Column:
    """Money total, NULL if there are no rows."""
    return F.sum(c).cast(TOTAL_SQL)


def mtotal0(c: Column | str) -> Column:
    """Money total, 0 if there are no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL_SQL)


def expenses_by_bank(gastos: DataFrame, until: str | None = None, tz: str | None = None) -> DataFrame:
    """Expenses per bank, optionally up to a business day (inclusive; in
    zone ``tz`` where times are UTC instants)."""
    g = gastos if until is None else gastos.filter(business_day("fecha_hora", tz) <= F.lit(until).cast("date"))
    return g.groupBy("banco_id").agg(msum("monto").alias("total"))


def legacy_transit(tx: DataFrame, until: str | None = None, tz: str | None = None) -> DataFrame:
    """|sum of Retiro cash with NULL bank| - sum |Depósito Cuenta cash|;
    no rows -> 0. One row. ``until``, ``tz``: as in E1."""
    t = tx if until is None else tx.filter(business_day("fecha_hora", tz) <= F.lit(until).cast("date"))
    ret = F.sum(F.when((F.col("tipo") == "Retiro") & F.col("banco_id").isNull(), F.col("monto_efectivo"))
                .otherwise(zero()))
    dep = F.sum(F.when(F.col("tipo") == "Depósito Cuenta", F.abs("monto_efectivo")).otherwise(zero()))
    return t.agg(F.coalesce(F.abs(ret) - dep, zero()).cast(TOTAL_SQL).alias("transito"))


def pending_remits_by_bank(rem: DataFrame) -> DataFrame:
    """Pending remittances per bank (NULL bank is its own group)."""
    return rem.filter(F.col("estado") == "Pendiente").groupBy("banco_id") \
              .agg(mtotal("monto").alias("total_remesa"))


def total_in_transit(rem: DataFrame, tx: DataFrame) -> DataFrame:
    """Legacy transit + all pending remittances (one row)."""
    pend = rem.filter(F.col("estado") == "Pendiente").agg(mtotal0("monto").alias("pendiente"))
    leg = legacy_transit(tx)
    # two one-row aggregates combined by a union + max (no join)
    both = (leg.select("transito", F.lit(None).cast(TOTAL_SQL).alias("pendiente"))
            .unionByName(pend.select(F.lit(None).cast(TOTAL_SQL).alias("transito"), "pendiente"))
            .agg(F.max("transito").alias("transito"), F.max("pendiente").alias("pendiente")))
    return both.select("transito", "pendiente",
                       (F.col("transito") + F.col("pendiente")).cast(TOTAL_SQL).alias("en_transito"))


def net_since_opening(tx: DataFrame, ap: DataFrame) -> DataFrame:
    """Net cash per (store, bank) since the store's latest opening."""
    return (since_opening(tx, ap, "fecha_hora").groupBy("tienda_id", "banco_id")
            .agg(msum("monto_efectivo").alias("neto_txn")))


def remitted_since_opening(rem: DataFrame, ap: DataFrame) -> DataFrame:
    """E5: remitted amount per (store, bank) since the store's latest opening."""
    return (since_opening(rem, ap, "fecha_envio").groupBy("tienda_id", "banco_id")
            .agg(msum("monto").alias("total_enviado")))


def treasury_flow(rem: DataFrame, log: DataFrame, bancos: DataFrame, since=None, until=None) -> DataFrame:
    """Flow per bank of ``bancos`` plus the 'Otros' row (NULL bank),
    strictly after ``since`` (None: whole history) and at or before ``until``.
    Banks with no rows get 0."""
    flows = flow_terms(rem, log, since, until).groupBy("banco_id").agg(F.sum("flujo").alias("flujo"))
    keys = bancos.select(F.col("id").alias("banco_id")).unionByName(
        bancos.sparkSession.range(1).select(F.lit(None).cast("long").alias("banco_id")))
    j = join_nullsafe(keys, flows, ["banco_id"], "left")
    return j.select("banco_id", F.coalesce("flujo", zero()).cast(MONEY_SQL).alias("flujo"))


def shift_by_type(tx: DataFrame, shifts: DataFrame, shift_id: str = "cierre_id", start: str = "desde",
                  end: str = "hasta") -> DataFrame:
    """Per shift and type: cash in, cash out, count, by prefix sums at both
    ends of each shift."""
    m = F.col("monto_efectivo")
    s = interval_sums(tx, shifts, "tienda_id", "tipo", {"entrada_ef": F.when(m > 0, m), "salida_ef": F.when(m < 0, -m)},
                      "fecha_hora", shift_id, start, end)
    return s.select(shift_id, "tipo", F.col("entrada_ef").cast(MONEY_SQL).alias("entrada_ef"),
                    F.col("salida_ef").cast(MONEY_SQL).alias("salida_ef"), F.col("n").alias("cantidad"))


def shift_by_bank(tx: DataFrame, shifts: DataFrame, bancos: DataFrame, shift_id: str = "cierre_id", start: str = "desde",
                  end: str = "hasta") -> DataFrame:
    """Per shift and bank: in, out, net, ops (NULL bank dropped by the
    inner join with the bank dimension), by prefix sums like E8."""
    b = bancos.select(F.col("id").alias("_bid"), F.col("nombre").alias("banco_nombre"),
                      F.col("color").alias("banco_color"))
    m = F.col("monto_efectivo")
    s = interval_sums(tx.filter(F.col("banco_id").isNotNull()), shifts, "tienda_id", "banco_id",
                      {"entrada_ef": F.when(m > 0, m), "salida_ef": F.when(m < 0, -m), "neto_ef": m}, "fecha_hora", shift_id, start, end)
    return s.join(b, s.banco_id == b._bid, "inner").select(
        shift_id, "banco_id", "banco_nombre", "banco_color",
        *[F.col(c).cast(MONEY_SQL).alias(c) for c in ("entrada_ef", "salida_ef", "neto_ef")], F.col("n").alias("ops"))


# Summary column -> (transaction type, measure).
SUMMARY_COLUMNS = [
    ("depositos", "Depósito", "entrada_ef"),
    ("retiros", "Retiro", "salida_ef"),
    ("pagos_servicio", "Pago Servicio", "entrada_ef"),
    ("caja_empresarial", "Pago Caja Empresarial", "entrada_ef"),
    ("efectivo_entregado", "Efectivo Entregado", "salida_ef"),
    ("deposito_cuenta", "Depósito Cuenta", "salida_ef"),
]


def shift_summary(by_type: DataFrame, shifts: DataFrame, shift_id: str = "cierre_id") -> DataFrame:
    """One row per shift, six type measures as columns (conditional sums
    = a pivot with fixed values) + total ops over all types; no tx -> 0."""
    aggs = [msum0(F.when(F.col("tipo") == t, F.col(meas))).alias(name)
            for name, t, meas in SUMMARY_COLUMNS]
    aggs.append(F.coalesce(F.sum("cantidad"), F.lit(0)).cast("long").alias("total_ops"))
    per = by_type.groupBy(shift_id).agg(*aggs)
    s = shifts.select(F.col(shift_id).alias("_sid"))
    j = s.join(per, s._sid == per[shift_id], "left")
    out = [F.col("_sid").alias(shift_id)]
    out += [F.coalesce(F.col(n), zero()).alias(n) for n, _, _ in SUMMARY_COLUMNS]
    out.append(F.coalesce("total_ops", F.lit(0)).cast("long").alias("total_ops"))
    return j.select(*out)


def shift_moved_total(summary: DataFrame) -> DataFrame:
    """Deposits + service payments + business-till payments."""
    return summary.withColumn("total_movido", (F.col("depositos") + F.col("pagos_servicio")
                                               + F.col("caja_empresarial")).cast(MONEY_SQL))


def closings_totals(enriched: DataFrame) -> DataFrame:
    """Totals over all closings (one row)."""
    return enriched.agg(F.count(F.lit(1)).alias("total_cierres"),
                        F.coalesce(F.sum("total_ops"), F.lit(0)).cast("long").alias("total_ops"),
                        mtotal0("depositos").alias("total_depositos"),
                        mtotal0("retiros").alias("total_retiros"),
                        mtotal0("total_entregado").alias("total_entregado"))


def audit_totals(matrix: DataFrame) -> DataFrame:
    """Per-bank column totals of the audit matrix (treasury row included)
    and the grand total of the ``efectivo`` column, as rows keyed by
    ``columna`` (bank id text, or 'efectivo')."""
    per_bank = matrix.groupBy("banco_id").agg(mtotal("total_banco").alias("total"))
    per_bank = per_bank.select(F.col("banco_id").cast("string").alias("columna"), "total")
    rows = matrix.select("fila", "efectivo").distinct()
    grand = rows.agg(mtotal("efectivo").alias("total")).select(F.lit("efectivo").alias("columna"), "total")
    return per_bank.unionByName(grand)


def global_bank_position(matrix: DataFrame, bancos: DataFrame, saldos: DataFrame) -> DataFrame:
    """Per bank with a balance row: cash in stores, in treasury, total and
    account balance."""
    m = F.col("total_banco")
    per = matrix.groupBy("banco_id").agg(
        msum0(F.when(F.col("fila") != "tesoreria", m)).alias("efectivo_tiendas"),
        msum0(F.when(F.col("fila") == "tesoreria", m)).alias("efectivo_tesoreria"))
    b = bancos.join(saldos.select(F.col("banco_id").alias("_sb"), "saldo"),
                    bancos.id == F.col("_sb"), "inner")
    j = b.join(per, b.id == per.banco_id, "left")
    et = F.coalesce("efectivo_tiendas", zero())
    es = F.coalesce("efectivo_tesoreria", zero())
    return j.select(F.col("id").alias("banco_id"), "nombre", "color", et.alias("efectivo_tiendas"),
                    es.alias("efectivo_tesoreria"), (et + es).cast(MONEY_SQL).alias("total"),
                    F.col("saldo").alias("saldo_cuenta"))


def outstanding_debt_total(dep: DataFrame) -> DataFrame:
    """Sum of pending advance deposits (one row)."""
    return dep.filter(F.col("estado") == "Pendiente").agg(mtotal0("monto").alias("deuda_total"))


def pending_counts(rem: DataFrame, dep: DataFrame) -> DataFrame:
    """Counts of pending remittances and pending advances (one row)."""
    r = rem.filter(F.col("estado") == "Pendiente").select(F.lit(1).alias("_r"), F.lit(0).alias("_d"))
    d = dep.filter(F.col("estado") == "Pendiente").select(F.lit(0).alias("_r"), F.lit(1).alias("_d"))
    return r.unionByName(d).agg(F.coalesce(F.sum("_r"), F.lit(0)).cast("long").alias("remesas_pendientes"),
                                F.coalesce(F.sum("_d"), F.lit(0)).cast("long").alias("deudas_pendientes"))


def opening_total(ap: DataFrame) -> DataFrame:
    """Per opening, the sum of its declared bank balances."""
    return ap.select("id", "tienda_id", map_total(balance_map("saldos_bancos_json")).alias("total_declarado"))


def shift_bank_totals(by_bank: DataFrame, shift_id: str = "cierre_id") -> DataFrame:
    """Per shift, totals over its bank rows."""
    return by_bank.groupBy(shift_id).agg(msum("entrada_ef").alias("total_entrada"),
                                         msum("salida_ef").alias("total_salida"),
                                         msum("neto_ef").alias("total_neto"))


def total_by_treasury(balances: DataFrame) -> DataFrame:
    """Total flow and total real balance over the treasury rows that
    are listed (H4 output)."""
    return balances.agg(mtotal0(F.when(F.col("en_flujo"), F.col("flujo"))).alias("total_flujo"),
                        mtotal0(F.when(F.col("en_saldos"), F.col("saldo"))).alias("total_real"))
