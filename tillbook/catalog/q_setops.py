"""Group G queries and their oracles."""

from __future__ import annotations


from tillbook.catalog import register
from tillbook.operators import filters as C
from tillbook.operators import setops as G
from tillbook.sources.store import StoredLedger as Ledger

# G1 by its rule: received remittances and log rows brought to one shape, then
# labelled by name lookups.
HISTORY_SQL = f"""
moves AS (
  SELECT 'remesa' AS source_table, id AS log_id, '{G.RECEIVED_LABEL}' AS tipo_trans, fecha_recepcion AS fecha, monto,
         observaciones AS ref, tienda_id AS store, banco_id AS bank, CAST(NULL AS BIGINT) AS target
  FROM remesas WHERE estado = 'Recibido' AND tienda_id IN (SELECT id FROM tiendas)
  UNION ALL BY NAME
  SELECT 'tesoreria_log' AS source_table, id AS log_id, tipo AS tipo_trans, fecha_hora AS fecha, monto, referencia AS ref,
         banco_id AS bank, banco_destino_id AS target FROM tesoreria_log),
named_moves AS (
  SELECT moves.*, (SELECT nombre FROM tiendas WHERE id = store) AS store_name,
         (SELECT nombre FROM bancos WHERE id = bank) AS bank_name, (SELECT nombre FROM bancos WHERE id = target) AS target_name
  FROM moves),
history AS (
  SELECT source_table, log_id, tipo_trans, fecha, monto, ref,
         CASE source_table WHEN 'remesa' THEN 'Efectivo' ELSE 'Banco' END AS via,
         CASE WHEN source_table = 'remesa' THEN store_name || '{G.PACKAGE_MARK}' || ifnull(bank_name, '{G.GENERAL_FUND}') || ')'
              WHEN target IS NULL THEN ifnull(bank_name, '{G.LOOSE_CASH}')
              ELSE ifnull(bank_name, '{G.LOOSE_CASH}') || '{G.ARROW_MARK}' || target_name END AS origen
  FROM named_moves)"""


def history_all(L, day=None):
    return G.treasury_history(L["remesas"], L["tesoreria_log"], L["tiendas"], L["bancos"], day)


@register("g1_treasury_history", "SELECT * FROM history", extra_ctes=HISTORY_SQL)
def g1(spark, d):
    return history_all(Ledger(spark, d))


@register("g1_treasury_history_day", "SELECT * FROM history WHERE CAST(fecha AS DATE) = DATE '1997-06-15'",
          extra_ctes=HISTORY_SQL)
def g1d(spark, d):
    return history_all(Ledger(spark, d), "1997-06-15")


@register("c7_bucket_history", """
SELECT *, CASE WHEN tipo_trans IN ('Remesa Recibida', 'Traslado (Efectivo)') THEN 'ingresos'
  WHEN tipo_trans IN ('Gasto Bancario', 'Entrega Dueño', 'Envío a Tienda', 'Pago Depósito Adelantado', 'Depósito a Banco') THEN 'salidas'
  WHEN tipo_trans IN ('Ajuste de Cuadre', 'Traslado (Solo Saldo)') THEN 'ajustes' END AS grupo
FROM history WHERE tipo_trans IN ('Remesa Recibida', 'Traslado (Efectivo)', 'Gasto Bancario', 'Entrega Dueño',
  'Envío a Tienda', 'Pago Depósito Adelantado', 'Depósito a Banco', 'Ajuste de Cuadre', 'Traslado (Solo Saldo)')""",
          extra_ctes=HISTORY_SQL)
def c7(spark, d):
    return C.bucket_history(history_all(Ledger(spark, d)))
