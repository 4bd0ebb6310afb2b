"""Group F queries and their oracles."""

from __future__ import annotations

from tillbook.catalog import register
from tillbook.catalog.q_setops import HISTORY_SQL, history_all
from tillbook.operators import windows as Fw
from tillbook.operators.postings import bank_postings, store_cash_postings
from tillbook.sources.store import StoredLedger as Ledger


@register("f1_latest_by_id", """
SELECT * FROM aperturas_caja WHERE id IN (SELECT MAX(id) FROM aperturas_caja GROUP BY tienda_id)""")
def f1(spark, d):
    return Fw.latest_by_id(Ledger(spark, d)["aperturas_caja"], "tienda_id")


@register("f2_latest_opening_ts", """
SELECT tienda_id, MAX(fecha_hora) AS ultima_apertura FROM aperturas_caja GROUP BY tienda_id""")
def f2(spark, d):
    return Fw.latest_opening_ts(Ledger(spark, d)["aperturas_caja"])


@register("f3_last_treasury_closing", """
SELECT x.id, COALESCE(x.fecha_hora, TIMESTAMP '1970-01-01 00:00:00') AS fecha_hora, COALESCE(x.saldos_json, '{}') AS saldos_json
FROM (SELECT 1 AS one) o LEFT JOIN (
  SELECT * FROM cierres_tesoreria ORDER BY fecha_hora DESC, id DESC LIMIT 1) x ON TRUE""")
def f3(spark, d):
    return Fw.last_treasury_closing(Ledger(spark, d)["cierres_tesoreria"])


@register("f4_history_top_n", """
SELECT * FROM history ORDER BY fecha DESC NULLS LAST, source_table, log_id DESC NULLS LAST, monto DESC, origen, ref
LIMIT 100""", extra_ctes=HISTORY_SQL)
def f4(spark, d):
    return Fw.history_top_n(history_all(Ledger(spark, d)), 100)


STORE_POSTINGS_SQL = r"""
bd_tot AS (
  SELECT c.id, COALESCE(SUM(TRY_CAST(replace(regexp_extract(trim(e), '^(.+?):\s*L\s*([\d.,]+)$', 2), ',', '') AS DECIMAL(18,2))), 0) AS entregado
  FROM cierres_caja c LEFT JOIN LATERAL (
    SELECT unnest(string_split(CASE WHEN position('ENTREGA:' IN COALESCE(split_part(c.desglose_bancos, '||', 2), '')) > 0
      THEN replace(split_part(c.desglose_bancos, '||', 2), 'ENTREGA:', '') ELSE '' END, '/')) AS e) u ON TRUE
  WHERE u.e IS NULL OR regexp_matches(trim(u.e), '^(.+?):\s*L\s*([\d.,]+)$')
  GROUP BY c.id),
store_postings AS (
  SELECT fecha_hora AS ts, tienda_id, saldo_inicial_efectivo AS monto, 'set' AS tipo_asiento, 'apertura' AS fuente,
         id AS fuente_id, 0 AS orden FROM aperturas_caja
  UNION ALL SELECT fecha_hora, tienda_id, monto_efectivo, 'delta', 'transaccion', id, 1 FROM transacciones
  UNION ALL SELECT c.fecha, c.tienda_id, GREATEST(c.saldo_real - COALESCE(b.entregado, 0), 0), 'set', 'cierre', c.id, 2
  FROM cierres_caja c LEFT JOIN bd_tot b ON b.id = c.id),
store_running AS (
  SELECT *, SUM(CASE WHEN tipo_asiento = 'set' THEN 1 ELSE 0 END) OVER (PARTITION BY tienda_id ORDER BY ts, orden, fuente_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
  FROM store_postings)"""


@register("f5_running_store_cash", """
SELECT ts, tienda_id, fuente, fuente_id, CAST(SUM(monto) OVER (PARTITION BY tienda_id, seg ORDER BY ts, orden, fuente_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS saldo
FROM store_running""", extra_ctes=STORE_POSTINGS_SQL)
def f5(spark, d):
    r = Fw.running_store_cash(store_cash_postings(Ledger(spark, d)))
    return r.select("ts", "tienda_id", "fuente", "fuente_id", "saldo")


@register("f6_running_bank_balance", """
SELECT ts, banco_id, fuente, fuente_id, CAST(SUM(monto) OVER (PARTITION BY banco_id, seg ORDER BY ts, orden, fuente_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS saldo
FROM (SELECT *, SUM(CASE WHEN tipo_asiento = 'set' THEN 1 ELSE 0 END) OVER (PARTITION BY banco_id ORDER BY ts, orden, fuente_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
      FROM (SELECT actualizado_en AS ts, banco_id, saldo AS monto, 'set' AS tipo_asiento, 'saldo' AS fuente,
                   banco_id AS fuente_id, 0 AS orden FROM saldos_bancarios
            UNION ALL SELECT fecha_hora, banco_id, monto_banco, 'delta', 'transaccion', id, 1
            FROM transacciones WHERE banco_id IS NOT NULL) p) q""")
def f6(spark, d):
    r = Fw.running_bank_balance(bank_postings(Ledger(spark, d)))
    return r.select("ts", "banco_id", "fuente", "fuente_id", "saldo")


@register("f7_shift_bounds", "SELECT cierre_id, tienda_id, desde, hasta, saldo_inicial_ef, ap_id AS apertura_id FROM shifts2",
          extra_ctes="""
shifts2 AS (
  SELECT c.id AS cierre_id, c.tienda_id, COALESCE(x.fecha_hora, TIMESTAMP '2000-01-01 00:00:00') AS desde, c.fecha AS hasta,
         CAST(COALESCE(x.saldo_inicial_efectivo, 0) AS DECIMAL(18,2)) AS saldo_inicial_ef, x.id AS ap_id
  FROM cierres_caja c LEFT JOIN LATERAL (
    SELECT a.* FROM aperturas_caja a WHERE a.tienda_id = c.tienda_id AND a.fecha_hora <= c.fecha
    ORDER BY a.fecha_hora DESC, a.id DESC LIMIT 1) x ON TRUE)""")
def f7(spark, d):
    L = Ledger(spark, d)
    return Fw.shift_bounds(L["aperturas_caja"], L["cierres_caja"])


@register("f8_sorted_closings", "SELECT * FROM cierres_caja ORDER BY fecha DESC, id DESC")
def f8(spark, d):
    from pyspark.sql import functions as F
    return Fw.sorted_listing(Ledger(spark, d)["cierres_caja"], [F.col("fecha").desc(), F.col("id").desc()])


@register("f5_current_store_cash", """
SELECT tienda_id, saldo FROM (
  SELECT tienda_id, CAST(SUM(monto) OVER (PARTITION BY tienda_id, seg ORDER BY ts, orden, fuente_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS saldo,
         ROW_NUMBER() OVER (PARTITION BY tienda_id ORDER BY ts DESC, orden DESC, fuente_id DESC) AS rn
  FROM store_running) x WHERE rn = 1""", extra_ctes=STORE_POSTINGS_SQL)
def f5c(spark, d):
    r = Fw.running_store_cash(store_cash_postings(Ledger(spark, d)))
    return Fw.current_balance(r, ["tienda_id"], "ts", ["orden", "fuente_id"])
