"""Group C queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.q_joins import ENRICH_TX_SQL
from tillbook.operators import filters as C
from tillbook.operators.joins import enrich_tx
from tillbook.sources.store import StoredLedger as Ledger

LAST_DAY_SQL = "(SELECT MAX(CAST(fecha_hora AS DATE)) FROM transacciones)"


def last_day(L):
    """The last business day present in the data, as a scalar subquery."""
    return L["transacciones"].select(F.max(F.to_date("fecha_hora"))).scalar()


def _enriched(L):
    return enrich_tx(L["transacciones"], L["tiendas"], L["bancos"], L["usuarios"])


@register("c1_transactions_listing", f"SELECT * FROM ({ENRICH_TX_SQL}) x WHERE tipo = 'Retiro'")
def c1(spark, d):
    L = Ledger(spark, d)
    return C.transactions_listing(L["transacciones"], L["tiendas"], L["bancos"], L["usuarios"], tipo="Retiro")


@register("c2_text_filter", f"""
SELECT * FROM ({ENRICH_TX_SQL}) x
WHERE lower(COALESCE(tienda_nombre, '')) LIKE '%nation_1%' AND lower(COALESCE(banco_nombre, '')) LIKE '%a%'
  AND CAST(fecha_hora AS DATE) = {LAST_DAY_SQL}""")
def c2(spark, d):
    L = Ledger(spark, d)
    e = _enriched(L)
    out = C.text_filter(e, "NATION_1", "a", None)
    return out.filter(F.to_date("fecha_hora") == last_day(L))


@register("c3_scope_to_role", """
SELECT t.* FROM transacciones t JOIN usuarios u ON u.rol = 'Cajero' AND u.id = (SELECT MIN(id) FROM usuarios WHERE rol = 'Cajero')
WHERE t.tienda_id = u.tienda_id""")
def c3(spark, d):
    L = Ledger(spark, d)
    # the first cashier's store, as a scalar subquery
    store = L["usuarios"].filter(F.col("rol") == "Cajero").agg(F.min_by("tienda_id", "id")).scalar()
    return C.scope_to_role(L["transacciones"], "Cajero", store)


@register("c3_scope_to_role_admin", "SELECT * FROM transacciones")
def c3b(spark, d):
    return C.scope_to_role(Ledger(spark, d)["transacciones"], "Admin", None)


@register("c4_distinct_types", "SELECT DISTINCT tipo FROM transacciones")
def c4(spark, d):
    return C.distinct_types(Ledger(spark, d)["transacciones"])


@register("c5_classify_type", """
SELECT id, tipo, CASE
  WHEN tipo = 'Ingreso' OR tipo = 'Sobrante' OR tipo LIKE '%Resurtido%' OR tipo LIKE '%Traspaso Entrada%' THEN 'type-ingreso'
  WHEN tipo = 'Retiro' OR tipo = 'Faltante' OR tipo LIKE '%Traspaso Salida%' THEN 'type-retiro'
  WHEN tipo = 'Pago Servicio' THEN 'type-pago'
  WHEN tipo LIKE '%Gasto%' THEN 'type-gasto' ELSE 'type-deposito' END AS clase
FROM transacciones""")
def c5(spark, d):
    return C.classify_type(Ledger(spark, d)["transacciones"]).select("id", "tipo", "clase")


@register("c6_open_tills", "SELECT * FROM aperturas_caja WHERE estado = 'Abierta'")
def c6a(spark, d):
    return C.open_tills(Ledger(spark, d)["aperturas_caja"])


@register("c6_pending_remits", "SELECT * FROM remesas WHERE estado = 'Pendiente'")
def c6b(spark, d):
    return C.pending_remits(Ledger(spark, d)["remesas"])


@register("c6_pending_debts", "SELECT * FROM depositos_adelantados WHERE estado = 'Pendiente'")
def c6c(spark, d):
    return C.pending_debts(Ledger(spark, d)["depositos_adelantados"])


TRANSFER_CMDS_SQL = """
transfer_cmds AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_totalprice - 200000 AS DECIMAL(18,2)) AS monto,
         CAST(NULLIF(o_custkey % 6, 5) AS BIGINT) AS origen, CAST(NULLIF(o_orderkey % 6, 5) AS BIGINT) AS destino
  FROM orders)"""


def transfer_commands(L):
    """Pouch-transfer commands derived from ``orders`` (some invalid)."""
    o = L.raw("orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    (F.col("o_totalprice") - 200000).cast("decimal(18,2)").alias("monto"),
                    F.nullif(F.col("o_custkey") % 6, F.lit(5)).alias("origen"),
                    F.nullif(F.col("o_orderkey") % 6, F.lit(5)).alias("destino"))


@register("c8_split_valid", """
SELECT id, monto, origen, destino,
  CASE WHEN monto IS NULL OR monto <= 0 THEN 'monto_invalido'
       WHEN origen IS NOT DISTINCT FROM destino THEN 'mismo_origen_destino' END AS motivo
FROM transfer_cmds""", extra_ctes=TRANSFER_CMDS_SQL)
def c8(spark, d):
    valid, rejected = C.split_valid(transfer_commands(Ledger(spark, d)), "monto", "origen", "destino")
    return valid.withColumn("motivo", F.lit(None).cast("string")).unionByName(rejected)


@register("c9_recover_principal", """
SELECT id, CAST(ABS(ABS(monto_efectivo) - ABS(COALESCE(comision_efectivo, 0))) AS DECIMAL(18,2)) AS monto_original
FROM transacciones""")
def c9(spark, d):
    return C.recover_principal(Ledger(spark, d)["transacciones"]).select("id", "monto_original")


@register("c11_cashiers_without_opening", f"""
SELECT u.* FROM usuarios u WHERE u.rol = 'Cajero' AND NOT EXISTS (
  SELECT 1 FROM aperturas_caja a WHERE a.usuario_id = u.id AND a.estado = 'Abierta'
  AND CAST(a.fecha_hora AS DATE) = {LAST_DAY_SQL})""")
def c11(spark, d):
    L = Ledger(spark, d)
    return C.cashiers_without_opening(L["usuarios"], L["aperturas_caja"], last_day(L))
