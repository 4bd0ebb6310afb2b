"""Reversal queries (I18, I23, I24) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.q_posting import TCMD_SQL, treasury_commands
from tillbook.operators import posting as I
from tillbook.operators import reversals as R
from tillbook.operators.windows import latest_by_id
from tillbook.sources.store import StoredLedger as Ledger

REV_LOG_SQL = TCMD_SQL.strip() + """,
sends AS (SELECT id, monto, ts FROM tv WHERE tipo_cmd = 'envio_tienda'),
restock AS (SELECT id, tienda_id, monto, ts FROM tv WHERE tipo_cmd = 'envio_tienda'),
send_near AS (
  SELECT s.id AS log_id, r.id AS transaccion_id
  FROM sends s JOIN restock r ON date_trunc('hour', s.ts) = date_trunc('hour', r.ts) AND ABS(s.monto - r.monto) < 0.1),
send_match AS (
  SELECT s.id AS log_id, r.id AS transaccion_id, r.tienda_id, s.monto, s.ts
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date_trunc('hour', ts), monto ORDER BY id) AS nth FROM sends) s
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY date_trunc('hour', ts), monto ORDER BY id) AS nth FROM restock) r
    ON date_trunc('hour', s.ts) = date_trunc('hour', r.ts) AND s.monto = r.monto AND s.nth = r.nth)"""


def _rev_log(spark, d):
    out = I.post_treasury_commands(treasury_commands(Ledger(spark, d)))
    log = out["log"].withColumnRenamed("comando_id", "id")
    ids = log.filter(F.col("tipo") == "Envío a Tienda").select("id", F.col("fecha_hora").alias("ts")).distinct()
    return R.reverse_treasury_log(log, ids, out["transacciones"])


@register("i23_reverse_treasury_log_matches", "SELECT log_id, transaccion_id FROM send_match",
          extra_ctes=REV_LOG_SQL)
def i23m(spark, d):
    return _rev_log(spark, d)["matched"]


@register("i23_reverse_treasury_log_postings", """
SELECT ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, CAST(-monto AS DECIMAL(18,2)) AS monto,
  'delta' AS tipo_asiento, 'reverso_tesoreria' AS fuente, log_id AS fuente_id, 3 AS orden
FROM send_match""", extra_ctes=REV_LOG_SQL)
def i23p(spark, d):
    return _rev_log(spark, d)["postings"]


@register("i23_reverse_treasury_log_bank_legs", """
SELECT fecha_hora AS ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id,
  CASE WHEN tipo = 'Depósito a Banco' THEN banco_destino_id ELSE banco_id END AS banco_id,
  CAST(CASE WHEN tipo = 'Gasto Bancario' THEN monto ELSE -monto END AS DECIMAL(18,2)) AS monto,
  'delta' AS tipo_asiento, 'reverso_tesoreria' AS fuente, id AS fuente_id, 3 AS orden
FROM tesoreria_log WHERE tipo IN ('Gasto Bancario', 'Depósito a Banco', 'Traslado (Efectivo)', 'Traslado (Solo Saldo)')
  AND (CASE WHEN tipo = 'Depósito a Banco' THEN banco_destino_id ELSE banco_id END) IS NOT NULL""")
def i23b(spark, d):
    L = Ledger(spark, d)
    log = L["tesoreria_log"]
    ids = log.select("id", F.col("fecha_hora").alias("ts"))
    return R.reverse_treasury_log(log, ids, L["transacciones"])["postings"]


REV_REM_SQL = """
rv AS (SELECT * FROM remesas WHERE estado = 'Pendiente')"""


def _rev_rem(spark, d):
    L = Ledger(spark, d)
    rem = L["remesas"]
    cmds = rem.select(F.col("id").alias("remesa_id"), (F.col("estado") == "Pendiente").alias("revertir"),
                      (F.col("fecha_envio") + F.expr("INTERVAL 1 DAYS")).alias("ts"))
    return R.reverse_remits(rem, cmds, L["transacciones"])


@register("i24_reverse_remits_postings", """
SELECT fecha_envio + INTERVAL 1 DAY AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, monto,
  'delta' AS tipo_asiento, 'reverso_remesa' AS fuente, id AS fuente_id, 3 AS orden FROM rv""", extra_ctes=REV_REM_SQL)
def i24p(spark, d):
    return _rev_rem(spark, d)["postings"]


@register("i24_reverse_remits_matches", """
SELECT arg_min(r.id, (r.fecha_envio, r.id)) AS remesa_id, t.id AS transaccion_id FROM transacciones t JOIN rv r
  ON t.tienda_id = r.tienda_id AND date_trunc('hour', t.fecha_hora) = date_trunc('hour', r.fecha_envio)
  AND ABS(t.monto_efectivo + r.monto) < 0.01
WHERE t.tipo = 'Efectivo Entregado' GROUP BY t.id""",
          extra_ctes=REV_REM_SQL)
def i24m(spark, d):
    return _rev_rem(spark, d)["matched"]


@register("i24_reverse_remits_transactions", """
SELECT t.* FROM transacciones t WHERE NOT (t.tipo = 'Efectivo Entregado' AND EXISTS (
  SELECT 1 FROM rv r WHERE r.tienda_id = t.tienda_id AND r.monto = -t.monto_efectivo
    AND date_trunc('hour', r.fecha_envio) = date_trunc('hour', t.fecha_hora)))""", extra_ctes=REV_REM_SQL)
def i24t(spark, d):
    return _rev_rem(spark, d)["transacciones"]


REV_CI_SQL = """
lci AS (SELECT * FROM cierres_caja WHERE id IN (SELECT MAX(id) FROM cierres_caja GROUP BY tienda_id))"""


def _rev_ci(spark, d):
    L = Ledger(spark, d)
    last = latest_by_id(L["cierres_caja"], "tienda_id")
    cmds = last.select(F.col("id").alias("cierre_id"), (F.col("fecha") + F.expr("INTERVAL 1 HOURS")).alias("ts"))
    return R.reverse_closings(L["cierres_caja"], L["aperturas_caja"], L["remesas"], cmds)


@register("i18_reverse_closings_postings", """
SELECT fecha + INTERVAL 1 HOUR AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, saldo_teorico AS monto,
  'set' AS tipo_asiento, 'reverso_cierre' AS fuente, id AS fuente_id, 3 AS orden FROM lci""", extra_ctes=REV_CI_SQL)
def i18p(spark, d):
    return _rev_ci(spark, d)["postings"]


@register("i18_reverse_closings_reopen", """
SELECT a.tienda_id, MAX(a.id) AS apertura_id FROM aperturas_caja a
WHERE a.estado = 'Cerrada' AND a.tienda_id IN (SELECT tienda_id FROM lci) GROUP BY a.tienda_id""", extra_ctes=REV_CI_SQL)
def i18r(spark, d):
    return _rev_ci(spark, d)["reabrir"]


@register("i18_reverse_closings_openings", """
SELECT a.* REPLACE (CASE WHEN a.id IN (SELECT MAX(x.id) FROM aperturas_caja x JOIN lci ON lci.tienda_id = x.tienda_id
    WHERE x.estado = 'Cerrada' GROUP BY x.tienda_id) THEN 'Abierta' ELSE a.estado END AS estado)
FROM aperturas_caja a""", extra_ctes=REV_CI_SQL)
def i18o(spark, d):
    return _rev_ci(spark, d)["aperturas"]


@register("i18_reverse_closings_dropped_remits", """
SELECT r.* FROM remesas r WHERE r.estado = 'Pendiente' AND EXISTS (
  SELECT 1 FROM lci c WHERE c.tienda_id = r.tienda_id AND CAST(c.fecha + INTERVAL 1 HOUR AS DATE) = CAST(r.fecha_envio AS DATE))""",
          extra_ctes=REV_CI_SQL)
def i18d(spark, d):
    return _rev_ci(spark, d)["remesas_eliminadas"]


from tillbook.catalog.q_cleaning import closing_forms  # noqa: E402
from tillbook.catalog.q_windows import STORE_POSTINGS_SQL  # noqa: E402
from tillbook.operators.postings import store_cash_postings  # noqa: E402

CLOSE_TILLS_SQL = STORE_POSTINGS_SQL.strip() + """,
store_bal AS (
  SELECT ts, tienda_id, orden, fuente_id, CAST(SUM(monto) OVER (PARTITION BY tienda_id, seg ORDER BY ts, orden, fuente_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS saldo FROM store_running),
cforms AS (SELECT (CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) * 1000 + tienda_id) * 10 + seq AS form_id, tienda_id,
                  CAST(d AS TIMESTAMP) + to_hours(CAST(seq * 2 + 18 AS BIGINT)) AS ts FROM closing_days),
before AS (
  SELECT f.form_id, f.tienda_id, f.ts,
    COALESCE((SELECT b.saldo FROM store_bal b WHERE b.tienda_id = f.tienda_id AND b.ts < f.ts
              ORDER BY b.ts DESC, b.orden DESC, b.fuente_id DESC LIMIT 1), CAST(0 AS DECIMAL(18,2))) AS saldo_teorico
  FROM cforms f),
decl AS (
  SELECT id AS tienda_id, CAST((id + 1) * 100 AS DECIMAL(18,2))
    + CAST(REPLACE(CASE WHEN (id + 1) * 200 >= 1000
        THEN CAST(((id + 1) * 200) // 1000 AS VARCHAR) || ',' || lpad(CAST(((id + 1) * 200) % 1000 AS VARCHAR), 3, '0') || '.50'
        ELSE CAST((id + 1) * 200 AS VARCHAR) || '.50' END, ',', '') AS DECIMAL(18,2)) + 25 AS declarado
  FROM tiendas)"""


@register("i17_close_tills", """
SELECT b.form_id, b.tienda_id, b.ts AS fecha, b.saldo_teorico, CAST(d.declarado AS DECIMAL(18,2)) AS saldo_real,
  CAST(d.declarado - b.saldo_teorico AS DECIMAL(18,2)) AS diferencia
FROM before b JOIN decl d ON d.tienda_id = b.tienda_id""", extra_ctes=CLOSE_TILLS_SQL)
def i17(spark, d):
    L = Ledger(spark, d)
    out = I.close_tills(closing_forms(L), store_cash_postings(L))
    return out["closings"].select("form_id", "tienda_id", "fecha", "saldo_teorico", "saldo_real", "diferencia")


@register("i17_close_tills_postings", """
SELECT b.ts, 'tienda' AS cuenta, b.tienda_id, CAST(NULL AS BIGINT) AS banco_id,
  CAST(GREATEST(d.declarado - CASE WHEN b.tienda_id % 2 = 0 THEN (b.tienda_id + 1) * 10 + 5 ELSE 0 END, 0) AS DECIMAL(18,2)) AS monto,
  'set' AS tipo_asiento, 'cierre' AS fuente, b.form_id AS fuente_id, 2 AS orden
FROM before b JOIN decl d ON d.tienda_id = b.tienda_id""", extra_ctes=CLOSE_TILLS_SQL)
def i17p(spark, d):
    L = Ledger(spark, d)
    return I.close_tills(closing_forms(L), store_cash_postings(L))["postings"]


@register("i17_close_tills_openings", """
SELECT a.* REPLACE (CASE WHEN a.estado = 'Abierta' AND EXISTS (
    SELECT 1 FROM cforms f WHERE f.tienda_id = a.tienda_id AND f.ts >= a.fecha_hora) THEN 'Cerrada' ELSE a.estado END AS estado)
FROM aperturas_caja a""", extra_ctes=CLOSE_TILLS_SQL)
def i17o(spark, d):
    L = Ledger(spark, d)
    return I.close_tills(closing_forms(L), store_cash_postings(L), L["aperturas_caja"])["aperturas"]


def _rev_transfers(spark, d, compat):
    out = I.post_treasury_commands(treasury_commands(Ledger(spark, d)))
    log = out["log"].withColumnRenamed("comando_id", "id")
    ids = log.filter(F.col("tipo").isin("Traslado (Efectivo)", "Traslado (Solo Saldo)")) \
             .select("id", F.col("fecha_hora").alias("ts")).distinct()
    return R.reverse_treasury_log(log, ids, out["transacciones"], compat=compat)["postings"]


@register("i23_reverse_transfers", """
SELECT ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_origen AS banco_id, CAST(-monto AS DECIMAL(18,2)) AS monto,
  'delta' AS tipo_asiento, 'reverso_tesoreria' AS fuente, id AS fuente_id, 3 AS orden
FROM tv WHERE tipo_cmd = 'traslado' AND modo <> 'solo_efectivo' AND banco_origen IS NOT NULL""", extra_ctes=REV_LOG_SQL)
def i23t(spark, d):
    """Default: only transfers that added to the bank give it back."""
    return _rev_transfers(spark, d, compat=False)


@register("i23_reverse_transfers_compat", """
SELECT ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_origen AS banco_id, CAST(-monto AS DECIMAL(18,2)) AS monto,
  'delta' AS tipo_asiento, 'reverso_tesoreria' AS fuente, id AS fuente_id, 3 AS orden
FROM tv WHERE tipo_cmd = 'traslado' AND banco_origen IS NOT NULL
UNION ALL
SELECT ts, 'banco', NULL, banco_destino, CAST(-monto AS DECIMAL(18,2)), 'delta', 'reverso_tesoreria', id, 3
FROM tv WHERE tipo_cmd = 'traspaso_bolsa' AND banco_destino IS NOT NULL""", extra_ctes=REV_LOG_SQL)
def i23tc(spark, d):
    """compat=True: every transfer row takes the amount off its bank, as the
    source does (also cash-only transfers and pouch entries)."""
    return _rev_transfers(spark, d, compat=True)


@register("i23_reverse_treasury_log_ambiguous", """
SELECT log_id, COUNT(*) AS candidatos FROM send_near GROUP BY log_id HAVING COUNT(*) > 1""", extra_ctes=REV_LOG_SQL)
def i23a(spark, d):
    return _rev_log(spark, d)["ambiguos"]
