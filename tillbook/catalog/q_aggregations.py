"""Group E queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.operators import aggregations as E
from tillbook.operators.joins import (
    TREASURY_INFLOW_LOG_TYPES, TREASURY_OUTFLOW_LOG_TYPES, asof_opening)
from tillbook.sources.store import StoredLedger as Ledger

# rows of a store at or after its newest opening
SINCE_SQL = """
reset_at AS (SELECT DISTINCT ON (tienda_id) tienda_id, fecha_hora AS ultima FROM aperturas_caja
             ORDER BY tienda_id, fecha_hora DESC),
live_tx AS (SELECT x.*, ultima FROM transacciones x NATURAL JOIN reset_at WHERE x.fecha_hora >= ultima),
live_rem AS (SELECT x.* FROM remesas x NATURAL JOIN reset_at WHERE x.fecha_envio >= ultima)"""
# Unbanked withdrawals against account deposits
TRANSIT_SQL = """
transit AS (
  SELECT SUM(monto_efectivo) FILTER (tipo = 'Retiro' AND banco_id IS NULL) AS out_cash,
         SUM(ABS(monto_efectivo)) FILTER (tipo = 'Depósito Cuenta') AS deposited FROM transacciones),
transit_total AS (
  SELECT CAST(ABS(ifnull(out_cash, 0)) - ifnull(deposited, 0) AS DECIMAL(38,2)) AS transito FROM transit)"""


@register("e1_expenses_by_bank", """
SELECT banco_id, CAST(SUM(monto) AS DECIMAL(18,2)) AS total FROM gastos
WHERE CAST(fecha_hora AS DATE) <= DATE '1997-12-31' GROUP BY banco_id""")
def e1(spark, d):
    return E.expenses_by_bank(Ledger(spark, d)["gastos"], until="1997-12-31")


@register("e2_legacy_transit", "FROM transit_total", extra_ctes=TRANSIT_SQL)
def e2(spark, d):
    return E.legacy_transit(Ledger(spark, d)["transacciones"])


@register("e3_pending_remits_by_bank", """
SELECT banco_id, CAST(SUM(monto) AS DECIMAL(38,2)) AS total_remesa FROM remesas
WHERE estado = 'Pendiente' GROUP BY banco_id""")
def e3a(spark, d):
    return E.pending_remits_by_bank(Ledger(spark, d)["remesas"])


@register("e3_total_in_transit", """
SELECT transito, pendiente, CAST(transito + pendiente AS DECIMAL(38,2)) AS en_transito
FROM transit_total, (SELECT CAST(ifnull(SUM(monto) FILTER (estado = 'Pendiente'), 0) AS DECIMAL(38,2)) AS pendiente
                     FROM remesas)""", extra_ctes=TRANSIT_SQL)
def e3b(spark, d):
    L = Ledger(spark, d)
    return E.total_in_transit(L["remesas"], L["transacciones"])


@register("e4_net_since_opening", """
SELECT tienda_id, banco_id, CAST(SUM(monto_efectivo) AS DECIMAL(18,2)) AS neto_txn FROM live_tx GROUP BY ALL""",
          extra_ctes=SINCE_SQL)
def e4(spark, d):
    L = Ledger(spark, d)
    return E.net_since_opening(L["transacciones"], L["aperturas_caja"])


@register("e5_remitted_since_opening", """
SELECT tienda_id, banco_id, CAST(SUM(monto) AS DECIMAL(18,2)) AS total_enviado FROM live_rem GROUP BY ALL""",
          extra_ctes=SINCE_SQL)
def e5(spark, d):
    L = Ledger(spark, d)
    return E.remitted_since_opening(L["remesas"], L["aperturas_caja"])


def sql_list(texts: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in texts)


def flow_sql(since_expr: str | None) -> str:
    cut_r = f"AND fecha_recepcion > {since_expr}" if since_expr else "AND fecha_recepcion IS NOT NULL"
    cut_l = f"AND fecha_hora > {since_expr}" if since_expr else "AND fecha_hora IS NOT NULL"
    return f"""
(SELECT k.banco_id, CAST(COALESCE(f.flujo, 0) AS DECIMAL(18,2)) AS flujo
 FROM (SELECT id AS banco_id FROM bancos UNION ALL SELECT CAST(NULL AS BIGINT)) k
 LEFT JOIN (
   SELECT banco_id, SUM(flujo) AS flujo FROM (
     SELECT banco_id, monto AS flujo FROM remesas WHERE estado = 'Recibido' {cut_r}
     UNION ALL SELECT banco_id, CASE WHEN tipo IN ({sql_list(TREASURY_INFLOW_LOG_TYPES)}) THEN monto ELSE -monto END
       FROM tesoreria_log WHERE tipo IN ({sql_list(TREASURY_INFLOW_LOG_TYPES + TREASURY_OUTFLOW_LOG_TYPES)}) {cut_l}
   ) u GROUP BY banco_id) f ON k.banco_id IS NOT DISTINCT FROM f.banco_id)"""


@register("e6_treasury_flow_since", "SELECT * FROM " + flow_sql("TIMESTAMP '2000-01-01 00:00:00'")
          + " x WHERE banco_id IS NOT NULL")
def e6(spark, d):
    L = Ledger(spark, d)
    f = E.treasury_flow(L["remesas"], L["tesoreria_log"], L["bancos"], "2000-01-01 00:00:00")
    return f.filter(F.col("banco_id").isNotNull())


@register("e7_treasury_flow_otros", "SELECT * FROM " + flow_sql("TIMESTAMP '2000-01-01 00:00:00'")
          + " x WHERE banco_id IS NULL")
def e7(spark, d):
    L = Ledger(spark, d)
    f = E.treasury_flow(L["remesas"], L["tesoreria_log"], L["bancos"], "2000-01-01 00:00:00")
    return f.filter(F.col("banco_id").isNull())


@register("e17_treasury_full_balance", "SELECT * FROM " + flow_sql(None) + " x")
def e17(spark, d):
    L = Ledger(spark, d)
    return E.treasury_flow(L["remesas"], L["tesoreria_log"], L["bancos"], None)


# --- shifts (D11 + D12 based) -------------------------------------------------
SHIFTS_CTE = """
opening_at AS (SELECT DISTINCT ON (tienda_id, fecha_hora) * FROM aperturas_caja ORDER BY tienda_id, fecha_hora, id DESC),
shifts AS (
  SELECT c.id AS cierre_id, c.tienda_id, ifnull(o.fecha_hora, TIMESTAMP '2000-01-01 00:00:00') AS desde, c.fecha AS hasta,
         CAST(ifnull(o.saldo_inicial_efectivo, 0) AS DECIMAL(18,2)) AS saldo_inicial_ef
  FROM cierres_caja c ASOF LEFT JOIN opening_at o ON o.tienda_id = c.tienda_id AND c.fecha >= o.fecha_hora),
shift_tx AS (
  SELECT cierre_id, x.* FROM transacciones x JOIN shifts ON shifts.tienda_id = x.tienda_id
   AND x.fecha_hora BETWEEN desde AND hasta),
shift_cells AS (
  SELECT cierre_id, tipo, banco_id, COUNT(*) AS n, ifnull(SUM(monto_efectivo), 0) AS net,
         ifnull(SUM(monto_efectivo) FILTER (monto_efectivo > 0), 0) AS cash_in,
         ifnull(-SUM(monto_efectivo) FILTER (monto_efectivo < 0), 0) AS cash_out
  FROM shift_tx GROUP BY ALL),
by_type AS (
  SELECT cierre_id, tipo, CAST(SUM(cash_in) AS DECIMAL(18,2)) AS entrada_ef,
         CAST(SUM(cash_out) AS DECIMAL(18,2)) AS salida_ef, CAST(SUM(n) AS BIGINT) AS cantidad
  FROM shift_cells GROUP BY cierre_id, tipo),
by_bank AS (
  SELECT g.*, bancos.nombre AS banco_nombre, bancos.color AS banco_color
  FROM bancos JOIN (
    SELECT cierre_id, banco_id, CAST(SUM(cash_in) AS DECIMAL(18,2)) AS entrada_ef,
           CAST(SUM(cash_out) AS DECIMAL(18,2)) AS salida_ef, CAST(SUM(net) AS DECIMAL(18,2)) AS neto_ef,
           CAST(SUM(n) AS BIGINT) AS ops
    FROM shift_cells GROUP BY cierre_id, banco_id) g ON bancos.id = g.banco_id),
summary AS (
  SELECT c.id AS cierre_id,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Depósito' THEN entrada_ef END), 0) AS DECIMAL(18,2)) AS depositos,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Retiro' THEN salida_ef END), 0) AS DECIMAL(18,2)) AS retiros,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Pago Servicio' THEN entrada_ef END), 0) AS DECIMAL(18,2)) AS pagos_servicio,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Pago Caja Empresarial' THEN entrada_ef END), 0) AS DECIMAL(18,2)) AS caja_empresarial,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Efectivo Entregado' THEN salida_ef END), 0) AS DECIMAL(18,2)) AS efectivo_entregado,
    CAST(COALESCE(SUM(CASE WHEN tipo = 'Depósito Cuenta' THEN salida_ef END), 0) AS DECIMAL(18,2)) AS deposito_cuenta,
    CAST(COALESCE(SUM(cantidad), 0) AS BIGINT) AS total_ops
  FROM cierres_caja c LEFT JOIN by_type t ON t.cierre_id = c.id GROUP BY c.id)
"""


def shifts_of(L):
    return asof_opening(L["cierres_caja"], L["aperturas_caja"]).select(
        F.col("id").alias("cierre_id"), "tienda_id", "desde", F.col("fecha").alias("hasta"), "saldo_inicial_ef")


@register("e8_shift_by_type", "SELECT * FROM by_type", extra_ctes=SHIFTS_CTE)
def e8(spark, d):
    L = Ledger(spark, d)
    return E.shift_by_type(L["transacciones"], shifts_of(L))


@register("e9_shift_by_bank", "SELECT * FROM by_bank", extra_ctes=SHIFTS_CTE)
def e9(spark, d):
    L = Ledger(spark, d)
    return E.shift_by_bank(L["transacciones"], shifts_of(L), L["bancos"])


@register("e10_shift_summary", "SELECT * FROM summary", extra_ctes=SHIFTS_CTE)
def e10(spark, d):
    L = Ledger(spark, d)
    shifts = shifts_of(L)
    return E.shift_summary(E.shift_by_type(L["transacciones"], shifts), shifts)


@register("e11_shift_moved_total", """
SELECT *, CAST(depositos + pagos_servicio + caja_empresarial AS DECIMAL(18,2)) AS total_movido FROM summary""",
          extra_ctes=SHIFTS_CTE)
def e11(spark, d):
    L = Ledger(spark, d)
    shifts = shifts_of(L)
    return E.shift_moved_total(E.shift_summary(E.shift_by_type(L["transacciones"], shifts), shifts))


@register("e19_shift_bank_totals", """
SELECT cierre_id, CAST(SUM(entrada_ef) AS DECIMAL(18,2)) AS total_entrada,
       CAST(SUM(salida_ef) AS DECIMAL(18,2)) AS total_salida, CAST(SUM(neto_ef) AS DECIMAL(18,2)) AS total_neto
FROM by_bank GROUP BY cierre_id""", extra_ctes=SHIFTS_CTE)
def e19(spark, d):
    L = Ledger(spark, d)
    return E.shift_bank_totals(E.shift_by_bank(L["transacciones"], shifts_of(L), L["bancos"]))


@register("h7_bank_summary", """
SELECT b.*, c.tienda_id, c.fecha FROM by_bank b JOIN cierres_caja c ON c.id = b.cierre_id
JOIN tiendas t ON t.id = c.tienda_id JOIN usuarios u ON u.id = c.usuario_id""", extra_ctes=SHIFTS_CTE)
def h7_banks(spark, d):
    from tillbook.plans.closings import closings_bank_summary
    return closings_bank_summary(Ledger(spark, d))


@register("e15_outstanding_debt_total", """
SELECT CAST(COALESCE(SUM(monto), 0) AS DECIMAL(38,2)) AS deuda_total FROM depositos_adelantados
WHERE estado = 'Pendiente'""")
def e15(spark, d):
    return E.outstanding_debt_total(Ledger(spark, d)["depositos_adelantados"])


@register("e16_pending_counts", """
SELECT (SELECT COUNT(*) FROM remesas WHERE estado = 'Pendiente') AS remesas_pendientes,
       (SELECT COUNT(*) FROM depositos_adelantados WHERE estado = 'Pendiente') AS deudas_pendientes""")
def e16(spark, d):
    L = Ledger(spark, d)
    return E.pending_counts(L["remesas"], L["depositos_adelantados"])


@register("e18_opening_total", """
SELECT a.id, a.tienda_id,
  CAST(COALESCE(SUM(COALESCE(TRY_CAST(json_extract_string(a.jj, '$."' || u.k || '"') AS DECIMAL(18,2)), 0)), 0)
       AS DECIMAL(18,2)) AS total_declarado
FROM (SELECT *, CASE WHEN json_valid(saldos_bancos_json) THEN saldos_bancos_json ELSE '{}' END AS jj
      FROM aperturas_caja) a
LEFT JOIN LATERAL (SELECT unnest(json_keys(a.jj)) AS k) u ON TRUE
GROUP BY a.id, a.tienda_id""")
def e18(spark, d):
    return E.opening_total(Ledger(spark, d)["aperturas_caja"])
