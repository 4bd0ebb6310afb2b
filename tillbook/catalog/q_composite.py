"""Group H queries (composite analytics) and their oracles, plus the
aggregations and filters defined over them (E12-E14, E20, C10, G3, I21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.q_aggregations import SHIFTS_CTE, flow_sql
from tillbook.catalog.q_cleaning import BREAKDOWN_SQL, FORMS_SQL, JS_NUM, closing_forms
from tillbook.catalog.q_filters import LAST_DAY_SQL, last_day
from tillbook.operators import aggregations as E
from tillbook.operators import filters as C
from tillbook.operators import setops as G
from tillbook.operators.joins import id_array
from tillbook.plans import audit as H
from tillbook.plans import closings as HC
from tillbook.plans import treasury as HT
from tillbook.sources.store import StoredLedger as Ledger

JV = "CASE WHEN json_valid({c}) THEN {c} ELSE '{{}}' END"
JGET = "COALESCE(TRY_CAST(json_extract_string({j}, '$.\"' || {k} || '\"') AS DECIMAL(18,2)), 0)"

AUDIT_CTES = f"""
last_ap AS (SELECT DISTINCT ON (tienda_id) * FROM aperturas_caja ORDER BY tienda_id, id DESC),
ap_json AS (SELECT tienda_id, id AS apertura_id, estado, saldo_inicial_efectivo,
                   {JV.format(c='saldos_bancos_json')} AS jj FROM last_ap),
ap_tot AS (SELECT a.tienda_id, COALESCE(SUM({JGET.format(j='a.jj', k='u.k')}), 0) AS sum_ini
           FROM ap_json a LEFT JOIN LATERAL (SELECT unnest(json_keys(a.jj)) AS k) u ON TRUE GROUP BY a.tienda_id),
net AS (SELECT t.tienda_id, t.banco_id, CAST(SUM(t.monto_efectivo) AS DECIMAL(18,2)) AS neto_txn FROM transacciones t
        JOIN (SELECT tienda_id, MAX(fecha_hora) AS ultima FROM aperturas_caja GROUP BY tienda_id) a ON t.tienda_id = a.tienda_id
        WHERE t.fecha_hora >= a.ultima GROUP BY t.tienda_id, t.banco_id),
cells AS (
  SELECT t.id AS tienda_id, b.id AS banco_id,
         CAST(CASE WHEN a.jj IS NULL THEN 0 ELSE {JGET.format(j='a.jj', k='CAST(b.id AS VARCHAR)')} END AS DECIMAL(18,2)) AS inicial,
         CAST(COALESCE(n.neto_txn, 0) AS DECIMAL(18,2)) AS neto
  FROM tiendas t CROSS JOIN bancos b LEFT JOIN ap_json a ON a.tienda_id = t.id
  LEFT JOIN net n ON n.tienda_id = t.id AND n.banco_id = b.id),
stores AS (
  SELECT t.id AS tienda_id, t.nombre AS tienda_nombre, t.efectivo_actual, a.apertura_id,
         COALESCE(a.estado, 'Sin Abrir') AS estado_caja,
         CAST(GREATEST(COALESCE(a.saldo_inicial_efectivo, 0) - COALESCE(s.sum_ini, 0), 0) AS DECIMAL(18,2)) AS inicial_otros,
         CAST(COALESCE(no.neto_txn, 0) AS DECIMAL(18,2)) AS neto_otros,
         (a.apertura_id IS NULL OR a.estado = 'Cerrada') AS cerrada,
         CAST(COALESCE(sc.total, 0) AS DECIMAL(18,2)) AS total_bancos
  FROM tiendas t LEFT JOIN ap_json a ON a.tienda_id = t.id LEFT JOIN ap_tot s ON s.tienda_id = t.id
  LEFT JOIN (SELECT * FROM net WHERE banco_id IS NULL) no ON no.tienda_id = t.id
  LEFT JOIN (SELECT tienda_id, SUM(CAST(inicial + neto AS DECIMAL(18,2))) AS total FROM cells GROUP BY tienda_id) sc
    ON sc.tienda_id = t.id),
stores2 AS (
  SELECT *, CAST(CASE WHEN cerrada THEN COALESCE(efectivo_actual, 0) ELSE total_bancos + inicial_otros + neto_otros END
                 AS DECIMAL(18,2)) AS efectivo FROM stores),
snap AS (
  SELECT COALESCE(x.fecha_hora, TIMESTAMP '1970-01-01 00:00:00') AS since,
         {JV.format(c="COALESCE(x.saldos_json, '{}')")} AS jj
  FROM (SELECT 1 AS one) o LEFT JOIN (SELECT * FROM cierres_tesoreria ORDER BY fecha_hora DESC, id DESC LIMIT 1) x ON TRUE),
tflow AS {flow_sql("(SELECT since FROM snap)")},
tcells AS (
  SELECT f.banco_id,
         CAST({JGET.format(j='s.jj', k="COALESCE(CAST(f.banco_id AS VARCHAR), 'Otros')")} AS DECIMAL(18,2)) AS base, f.flujo
  FROM tflow f, snap s),
matrix AS (
  SELECT CAST(c.tienda_id AS VARCHAR) AS fila, s.tienda_nombre AS nombre, c.banco_id,
         CAST(c.inicial + c.neto AS DECIMAL(18,2)) AS total_banco, s.efectivo
  FROM cells c JOIN stores2 s ON s.tienda_id = c.tienda_id
  UNION ALL
  SELECT 'tesoreria', '📦 Tesorería Central', banco_id, CAST(base + flujo AS DECIMAL(18,2)),
         (SELECT CAST(SUM(base + flujo) AS DECIMAL(18,2)) FROM tcells)
  FROM tcells WHERE banco_id IS NOT NULL),
last_ci AS (SELECT DISTINCT ON (tienda_id) * FROM cierres_caja ORDER BY tienda_id, id DESC),
refs AS (
  SELECT s.tienda_id, s.tienda_nombre, s.efectivo_actual, s.estado_caja,
         CASE WHEN s.estado_caja = 'Cerrada' THEN lc.id END AS cierre_id, s.efectivo AS total_esperado_tienda,
         CAST(c.banco_id AS VARCHAR) AS banco_key, c.inicial, c.neto, CAST(c.inicial + c.neto AS DECIMAL(18,2)) AS total_esperado
  FROM cells c JOIN stores2 s ON s.tienda_id = c.tienda_id LEFT JOIN last_ci lc ON lc.tienda_id = s.tienda_id
  UNION ALL
  SELECT s.tienda_id, s.tienda_nombre, s.efectivo_actual, s.estado_caja,
         CASE WHEN s.estado_caja = 'Cerrada' THEN lc.id END, s.efectivo, 'Otros', s.inicial_otros, s.neto_otros,
         CAST(s.inicial_otros + s.neto_otros AS DECIMAL(18,2))
  FROM stores2 s LEFT JOIN last_ci lc ON lc.tienda_id = s.tienda_id),
tbal AS (
  SELECT CAST(t.banco_id AS VARCHAR) AS banco_key, b.nombre, t.base, t.flujo, CAST(t.base + t.flujo AS DECIMAL(18,2)) AS saldo,
         TRUE AS en_flujo, TRUE AS en_saldos
  FROM tcells t JOIN bancos b ON b.id = t.banco_id
  UNION ALL
  SELECT 'Otros', 'Fondo General', base, flujo, CAST(base + flujo AS DECIMAL(18,2)), flujo <> 0, (base + flujo) <> 0
  FROM tcells WHERE banco_id IS NULL)"""


@register("h1_audit_matrix", "SELECT * FROM matrix", extra_ctes=AUDIT_CTES)
def h1(spark, d):
    return H.audit_matrix(Ledger(spark, d))


@register("h2_store_reference", "SELECT * FROM refs", extra_ctes=AUDIT_CTES)
def h2(spark, d):
    return H.store_reference(Ledger(spark, d))


@register("c10_visible_refs", "SELECT * FROM refs WHERE total_esperado <> 0 OR inicial <> 0", extra_ctes=AUDIT_CTES)
def c10(spark, d):
    return C.visible_refs(H.store_reference(Ledger(spark, d)))


@register("e13_audit_totals", """
SELECT CAST(banco_id AS VARCHAR) AS columna, CAST(SUM(total_banco) AS DECIMAL(38,2)) AS total FROM matrix GROUP BY banco_id
UNION ALL SELECT 'efectivo', CAST(SUM(efectivo) AS DECIMAL(38,2)) FROM (SELECT DISTINCT fila, efectivo FROM matrix) x""",
          extra_ctes=AUDIT_CTES)
def e13(spark, d):
    return E.audit_totals(H.audit_matrix(Ledger(spark, d)))


@register("e14_global_bank_position", """
SELECT b.id AS banco_id, b.nombre, b.color,
  CAST(COALESCE(SUM(CASE WHEN m.fila <> 'tesoreria' THEN m.total_banco END), 0) AS DECIMAL(18,2)) AS efectivo_tiendas,
  CAST(COALESCE(SUM(CASE WHEN m.fila = 'tesoreria' THEN m.total_banco END), 0) AS DECIMAL(18,2)) AS efectivo_tesoreria,
  CAST(COALESCE(SUM(m.total_banco), 0) AS DECIMAL(18,2)) AS total, s.saldo AS saldo_cuenta
FROM bancos b JOIN saldos_bancarios s ON s.banco_id = b.id LEFT JOIN matrix m ON m.banco_id = b.id
GROUP BY b.id, b.nombre, b.color, s.saldo""", extra_ctes=AUDIT_CTES)
def e14(spark, d):
    L = Ledger(spark, d)
    return E.global_bank_position(H.audit_matrix(L), L["bancos"], L["saldos_bancarios"])


@register("h4_treasury_balances", "SELECT * FROM tbal", extra_ctes=AUDIT_CTES)
def h4(spark, d):
    return HT.treasury_balances(Ledger(spark, d))


@register("h4_treasury_totals", """
SELECT CAST(ifnull(SUM(flujo) FILTER (en_flujo), 0) AS DECIMAL(38,2)) AS total_flujo,
  CAST(ifnull(SUM(saldo) FILTER (en_saldos), 0) AS DECIMAL(38,2)) AS total_real,
  (SELECT CAST(ifnull(SUM(monto), 0) AS DECIMAL(38,2)) FROM remesas SEMI JOIN tiendas ON tiendas.id = tienda_id WHERE estado = 'Pendiente') AS en_transito,
  (SELECT CAST(ifnull(SUM(monto), 0) AS DECIMAL(38,2)) FROM depositos_adelantados SEMI JOIN bancos ON bancos.id = banco_id
   WHERE estado = 'Pendiente') AS deuda_total
FROM tbal""", extra_ctes=AUDIT_CTES)
def h4_totals(spark, d):
    return HT.treasury_page(Ledger(spark, d))["totales"]


@register("g3_append_otros_nonzero", "SELECT banco_key, flujo FROM tbal WHERE banco_key <> 'Otros' OR flujo <> 0",
          extra_ctes=AUDIT_CTES)
def g3(spark, d):
    rows = HT.treasury_balances(Ledger(spark, d)).select("banco_key", "flujo")
    is_other = F.col("banco_key") == "Otros"
    return G.append_otros(rows.filter(~is_other), rows.filter(is_other), "flujo", only_nonzero=True)


@register("e20_total_by_treasury", """
SELECT CAST(COALESCE(SUM(CASE WHEN en_flujo THEN flujo END), 0) AS DECIMAL(38,2)) AS total_flujo,
       CAST(COALESCE(SUM(CASE WHEN en_saldos THEN saldo END), 0) AS DECIMAL(38,2)) AS total_real FROM tbal""",
          extra_ctes=AUDIT_CTES)
def e20(spark, d):
    return E.total_by_treasury(HT.treasury_balances(Ledger(spark, d)))


@register("i21_close_treasury", f"""
SELECT TIMESTAMP '2024-02-01 00:00:00' AS fecha_hora, CAST(NULL AS BIGINT) AS usuario_id,
  '{{' || string_agg('"' || banco_key || '":' || {JS_NUM.format(v='saldo')}, ','
     ORDER BY CASE WHEN regexp_matches(banco_key, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(banco_key AS BIGINT), banco_key)
  || '}}' AS saldos_json,
  CAST(SUM(saldo) AS DECIMAL(18,2)) AS total_efectivo, 'Corte de Caja Central' AS observaciones
FROM tbal""", extra_ctes=AUDIT_CTES)
def i21(spark, d):
    return HT.close_treasury(Ledger(spark, d), "2024-02-01 00:00:00")


OPEN_CTES = f"""
lastt AS (SELECT * FROM (SELECT a.*, ROW_NUMBER() OVER (PARTITION BY tienda_id ORDER BY fecha_hora DESC, id DESC) AS rn
                         FROM aperturas_caja a) z WHERE rn = 1),
st AS (SELECT t.id AS tienda_id, l.saldo_inicial_efectivo AS ap_cash,
              CASE WHEN l.id IS NULL THEN NULL ELSE {JV.format(c='l.saldos_bancos_json')} END AS jj,
              COALESCE(l.fecha_hora, TIMESTAMP '2000-01-01 00:00:00') AS since
       FROM tiendas t LEFT JOIN lastt l ON l.tienda_id = t.id),
st_tot AS (SELECT s.tienda_id, COALESCE(SUM({JGET.format(j='s.jj', k='u.k')}), 0) AS sum_ini
           FROM st s LEFT JOIN LATERAL (SELECT unnest(json_keys(COALESCE(s.jj, '{{}}'))) AS k) u ON TRUE GROUP BY s.tienda_id),
net2 AS (SELECT x.tienda_id, x.banco_id, CAST(SUM(x.monto_efectivo) AS DECIMAL(18,2)) AS neto
         FROM transacciones x JOIN st ON st.tienda_id = x.tienda_id WHERE x.fecha_hora >= st.since
         GROUP BY x.tienda_id, x.banco_id),
per_bank AS (
  SELECT t.id AS tienda_id, CAST(b.id AS VARCHAR) AS banco_key,
         CAST(CASE WHEN s.jj IS NULL THEN 0 ELSE {JGET.format(j='s.jj', k='CAST(b.id AS VARCHAR)')} END + COALESCE(n.neto, 0)
              AS DECIMAL(18,2)) AS fisico
  FROM tiendas t CROSS JOIN bancos b JOIN st s ON s.tienda_id = t.id
  LEFT JOIN net2 n ON n.tienda_id = t.id AND n.banco_id = b.id)"""


@register("h5_suggested_opening", """
SELECT tienda_id, banco_key, CAST(GREATEST(fisico, 0) AS DECIMAL(18,2)) AS sugerido FROM per_bank
UNION ALL
SELECT s.tienda_id, 'Otros', CAST(GREATEST(GREATEST(COALESCE(s.ap_cash, 0) - COALESCE(tt.sum_ini, 0), 0) + COALESCE(n.neto, 0), 0)
       AS DECIMAL(18,2))
FROM st s LEFT JOIN st_tot tt ON tt.tienda_id = s.tienda_id
LEFT JOIN (SELECT * FROM net2 WHERE banco_id IS NULL) n ON n.tienda_id = s.tienda_id""", extra_ctes=OPEN_CTES)
def h5(spark, d):
    return H.suggested_opening(Ledger(spark, d))


@register("h6_physical_by_bank", "SELECT * FROM per_bank", extra_ctes=OPEN_CTES)
def h6(spark, d):
    return H.physical_by_bank(Ledger(spark, d))


OPEN_TILL_CTE = """
op AS (SELECT tienda_id, MIN(id) AS apertura_id, arg_min(saldo_inicial_efectivo, id) AS ap_cash,
              arg_min(saldos_bancos_json, id) AS ap_json
       FROM aperturas_caja WHERE estado = 'Abierta' GROUP BY tienda_id)"""


@register("h11_initial_config_map", f"""
SELECT t.id AS tienda_id, CAST(b.id AS VARCHAR) AS clave,
  CAST(CASE WHEN o.ap_json IS NULL THEN 0 ELSE {JGET.format(j=JV.format(c='o.ap_json'), k='CAST(b.id AS VARCHAR)')} END
       AS DECIMAL(18,2)) AS monto
FROM tiendas t CROSS JOIN bancos b LEFT JOIN op o ON o.tienda_id = t.id
UNION ALL
SELECT t.id, 'efectivo', CAST(COALESCE(o.ap_cash, 0) AS DECIMAL(18,2)) FROM tiendas t LEFT JOIN op o ON o.tienda_id = t.id""",
          extra_ctes=OPEN_TILL_CTE)
def h11(spark, d):
    return H.initial_config_map(Ledger(spark, d))


def config_forms(L):
    """Initial-configuration forms, one per store: new cash total and a value
    per bank."""
    t = F.col("id")
    cash = F.array(F.struct(F.concat(F.lit("monto_efectivo_"), t.cast("string")).alias("k"),
                        F.concat(F.lit("L "), ((t + 1) * 500).cast("string"), F.lit(".00")).alias("v")))
    banks = F.transform(F.col("_ids"), lambda b: F.struct(
        F.concat(F.lit("monto_banco_"), t.cast("string"), F.lit("_"), b.cast("string")).alias("k"),
        F.concat(F.lit("L "), ((t + 1) * (b + 1) * 10).cast("string")).alias("v")))
    return (L["tiendas"].withColumn("_ids", id_array(L["bancos"]))
            .select(t.alias("form_id"), F.map_from_entries(F.concat(cash, banks)).alias("form")))


@register("h12_apply_initial_config", """
SELECT t.id AS form_id, t.id AS tienda_id, o.apertura_id, o.ap_cash AS anterior_total,
  CAST((t.id + 1) * 500 AS DECIMAL(18,2)) AS nuevo_total,
  '{' || (SELECT string_agg('"' || CAST(b.id AS VARCHAR) || '":' || CAST((t.id + 1) * (b.id + 1) * 10 AS VARCHAR), ','
          ORDER BY b.id) FROM bancos b) || '}' AS nuevo_json,
  CAST((t.id + 1) * 500 - o.ap_cash AS DECIMAL(18,2)) AS delta_efectivo
FROM tiendas t JOIN op o ON o.tienda_id = t.id""", extra_ctes=OPEN_TILL_CTE)
def h12(spark, d):
    L = Ledger(spark, d)
    return H.apply_initial_config(config_forms(L), L)


CONFIG_AT = "2024-03-01 09:00:00"


@register("h12_initial_config_openings", """
SELECT a.* REPLACE (CASE WHEN o.tienda_id IS NULL THEN saldo_inicial_efectivo ELSE CAST((o.tienda_id + 1) * 500 AS DECIMAL(18,2)) END
    AS saldo_inicial_efectivo,
  CASE WHEN o.tienda_id IS NULL THEN saldos_bancos_json ELSE '{' || (
    SELECT string_agg('"' || bancos.id || '":' || ((o.tienda_id + 1) * (bancos.id + 1) * 10), ',' ORDER BY bancos.id) FROM bancos) || '}' END
    AS saldos_bancos_json)
FROM aperturas_caja a LEFT JOIN (SELECT op.* FROM op SEMI JOIN tiendas ON tiendas.id = op.tienda_id) o ON o.apertura_id = a.id""",
          extra_ctes=OPEN_TILL_CTE)
def h12_openings(spark, d):
    L = Ledger(spark, d)
    return H.initial_config_frames(config_forms(L), L, CONFIG_AT)["aperturas"]


@register("h12_initial_config_postings", f"""
SELECT TIMESTAMP '{CONFIG_AT}' AS ts, 'tienda' AS cuenta, t.id AS tienda_id, CAST(NULL AS BIGINT) AS banco_id,
  CAST((t.id + 1) * 500 - coalesce(o.ap_cash, 0) AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'configuracion' AS fuente,
  t.id AS fuente_id, 1 AS orden
FROM tiendas t JOIN op o ON o.tienda_id = t.id WHERE (t.id + 1) * 500 <> coalesce(o.ap_cash, 0)""", extra_ctes=OPEN_TILL_CTE)
def h12_postings(spark, d):
    L = Ledger(spark, d)
    return H.initial_config_frames(config_forms(L), L, CONFIG_AT)["postings"]


@register("h13_cashier_dashboard", f"""
SELECT u.id AS usuario_id, u.tienda_id, CAST(COALESCE(t.efectivo_actual, 0) AS DECIMAL(18,2)) AS saldo_anterior,
  a.apertura_id, CAST(COALESCE(a.total, 0) AS DECIMAL(18,2)) AS total_apertura
FROM usuarios u LEFT JOIN tiendas t ON t.id = u.tienda_id
LEFT JOIN (
  SELECT x.usuario_id, x.id AS apertura_id, COALESCE(SUM({JGET.format(j='x.jj', k='k.k')}), 0) AS total
  FROM (SELECT usuario_id, MIN(id) AS id, arg_min({JV.format(c='saldos_bancos_json')}, id) AS jj FROM aperturas_caja
        WHERE estado = 'Abierta' AND CAST(fecha_hora AS DATE) = {LAST_DAY_SQL} GROUP BY usuario_id) x
  LEFT JOIN LATERAL (SELECT unnest(json_keys(x.jj)) AS k) k ON TRUE GROUP BY x.usuario_id, x.id
) a ON a.usuario_id = u.id
WHERE u.rol = 'Cajero'""")
def h13(spark, d):
    L = Ledger(spark, d)
    return H.cashier_dashboard(L, last_day(L))


@register("h13_cashier_opening_banks", f"""
SELECT u.id AS usuario_id, x.id AS apertura_id, k.k AS clave, CAST({JGET.format(j='x.jj', k='k.k')} AS DECIMAL(18,2)) AS monto
FROM usuarios u JOIN (
  SELECT usuario_id, MIN(id) AS id, arg_min({JV.format(c='saldos_bancos_json')}, id) AS jj FROM aperturas_caja
  WHERE estado = 'Abierta' AND CAST(fecha_hora AS DATE) = {LAST_DAY_SQL} GROUP BY usuario_id) x ON x.usuario_id = u.id,
  LATERAL (SELECT unnest(json_keys(x.jj)) AS k) k
WHERE u.rol = 'Cajero'""")
def h13_banks(spark, d):
    L = Ledger(spark, d)
    return H.cashier_opening_banks(L, last_day(L))


@register("h15_suggest_close_reminder", f"""
SELECT a.tienda_id, a.id AS apertura_id, a.fecha_hora AS desde FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tienda_id ORDER BY fecha_hora DESC, id DESC) AS rn FROM aperturas_caja
  WHERE fecha_hora <= CAST({LAST_DAY_SQL} AS TIMESTAMP) + INTERVAL 17 HOUR + INTERVAL 55 MINUTE) a
LEFT JOIN (SELECT tienda_id, MAX(fecha) AS lc FROM cierres_caja
           WHERE fecha <= CAST({LAST_DAY_SQL} AS TIMESTAMP) + INTERVAL 17 HOUR + INTERVAL 55 MINUTE GROUP BY tienda_id) c
  ON c.tienda_id = a.tienda_id
WHERE a.rn = 1 AND (c.lc IS NULL OR c.lc < a.fecha_hora)""")
def h15(spark, d):
    L = Ledger(spark, d)
    return H.suggest_close_reminder(L, last_day(L))


H7_CTES = SHIFTS_CTE.strip() + ",\n" + BREAKDOWN_SQL.strip() + """,
h7 AS (
  SELECT c.id, c.tienda_id, t.nombre AS tienda_nombre, u.username, c.fecha, c.saldo_teorico, c.saldo_real, c.diferencia,
    CAST(COALESCE((SELECT SUM(monto) FROM bd_long b WHERE b.id = c.id AND b.parte = 'declarado'), 0) AS DECIMAL(18,2)) AS total_declarado,
    CAST(COALESCE((SELECT SUM(monto) FROM bd_long b WHERE b.id = c.id AND b.parte = 'entregado'), 0) AS DECIMAL(18,2)) AS total_entregado,
    s.desde, s.saldo_inicial_ef, m.depositos, m.retiros, m.pagos_servicio, m.caja_empresarial, m.efectivo_entregado,
    m.deposito_cuenta, m.total_ops, CAST(m.depositos + m.pagos_servicio + m.caja_empresarial AS DECIMAL(18,2)) AS total_movido
  FROM cierres_caja c JOIN tiendas t ON c.tienda_id = t.id JOIN usuarios u ON c.usuario_id = u.id
  JOIN shifts s ON s.cierre_id = c.id LEFT JOIN summary m ON m.cierre_id = c.id)"""


@register("h7_closings_enriched", "SELECT * FROM h7", extra_ctes=H7_CTES)
def h7(spark, d):
    return HC.closings_enriched(Ledger(spark, d))


@register("h7_maps", """
SELECT id AS cierre_id, clave, MAX(monto) FILTER (WHERE parte = 'declarado') AS declarado,
       MAX(monto) FILTER (WHERE parte = 'entregado') AS entregado
FROM bd_long SEMI JOIN (SELECT c.id FROM cierres_caja c, tiendas t, usuarios u WHERE t.id = c.tienda_id AND u.id = c.usuario_id) USING (id)
GROUP BY ALL""", extra_ctes=BREAKDOWN_SQL)
def h7_maps(spark, d):
    return HC.closings_maps(Ledger(spark, d))


@register("e12_closings_totals", """
SELECT COUNT(*) AS total_cierres, CAST(COALESCE(SUM(total_ops), 0) AS BIGINT) AS total_ops,
  CAST(COALESCE(SUM(depositos), 0) AS DECIMAL(38,2)) AS total_depositos,
  CAST(COALESCE(SUM(retiros), 0) AS DECIMAL(38,2)) AS total_retiros,
  CAST(COALESCE(SUM(total_entregado), 0) AS DECIMAL(38,2)) AS total_entregado FROM h7""", extra_ctes=H7_CTES)
def e12(spark, d):
    return E.closings_totals(HC.closings_enriched(Ledger(spark, d)))


@register("h9_variance_class", """
SELECT id, CASE WHEN ABS(diferencia) < 0.01 THEN 'CUADRA' WHEN diferencia < 0 THEN 'FALTA' ELSE 'SOBRA' END AS clase,
  CASE WHEN ABS(diferencia) < 0.01 THEN 'CUADRA' WHEN diferencia < 0 THEN 'FALTA L ' || CAST(CAST(ABS(diferencia) AS DECIMAL(18,2)) AS VARCHAR)
       ELSE 'SOBRA L ' || CAST(CAST(diferencia AS DECIMAL(18,2)) AS VARCHAR) END AS etiqueta,
  CAST(GREATEST(COALESCE(saldo_real, 0) - COALESCE(total_entregado, 0), 0) AS DECIMAL(18,2)) AS queda_manana
FROM h7""", extra_ctes=H7_CTES)
def h9(spark, d):
    return HC.variance_class(HC.closings_enriched(Ledger(spark, d))).select("id", "clase", "etiqueta", "queda_manana")


@register("h14_closings_report", """
SELECT c.*, t.nombre AS tienda_nombre, u.username,
  CASE WHEN c.diferencia > 0 THEN '+' ELSE '' END || CAST(CAST(COALESCE(c.diferencia, 0) AS DECIMAL(18,2)) AS VARCHAR) AS diferencia_texto
FROM cierres_caja c JOIN tiendas t ON c.tienda_id = t.id JOIN usuarios u ON c.usuario_id = u.id""")
def h14(spark, d):
    return HC.closings_report(Ledger(spark, d))


def _forms_and_expected(L):
    forms = closing_forms(L)
    exp = forms.join(L["tiendas"].select(F.col("id").alias("tienda_id"), "efectivo_actual"), "tienda_id", "left") \
               .select("form_id", F.col("efectivo_actual").alias("saldo_teorico"))
    return forms, exp


FORM_PARTS_SQL = FORMS_SQL.strip() + """,
form_parts AS (
  SELECT form_id, banco_key AS clave, SUM(CASE WHEN campo = 'banco' THEN monto END) AS declarado,
         SUM(CASE WHEN campo = 'entrega_banco' THEN monto END) AS entregado
  FROM forms_melt GROUP BY form_id, banco_key),
form_heads AS (SELECT DISTINCT form_id, tienda_id, ts FROM forms_long),
h8 AS (
  SELECT h.form_id, h.tienda_id, h.ts AS fecha, CAST(COALESCE(t.efectivo_actual, 0) AS DECIMAL(18,2)) AS saldo_teorico,
    CAST(COALESCE(p.dec, 0) AS DECIMAL(18,2)) AS saldo_real,
    CAST(COALESCE(p.dec, 0) - COALESCE(t.efectivo_actual, 0) AS DECIMAL(18,2)) AS diferencia,
    COALESCE(x.txt, '') AS desglose_bancos,
    CAST(GREATEST(COALESCE(p.dec, 0) - COALESCE(p.ent, 0), 0) AS DECIMAL(18,2)) AS saldo_final
  FROM form_heads h LEFT JOIN tiendas t ON t.id = h.tienda_id
  LEFT JOIN (SELECT form_id, SUM(declarado) AS dec, SUM(entregado) AS ent FROM form_parts GROUP BY form_id) p ON p.form_id = h.form_id
  LEFT JOIN (
    SELECT form_id,
      CASE WHEN COUNT(*) FILTER (WHERE entregado > 0) > 0 THEN
        string_agg(CASE WHEN declarado IS NOT NULL THEN clave || ': L ' || CAST(CAST(declarado AS DECIMAL(18,2)) AS VARCHAR) END, ' | '
          ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave)
        || ' || ENTREGA: ' ||
        string_agg(CASE WHEN entregado > 0 THEN clave || ': L ' || CAST(CAST(entregado AS DECIMAL(18,2)) AS VARCHAR) END, ' / '
          ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave)
      ELSE string_agg(CASE WHEN declarado IS NOT NULL THEN clave || ': L ' || CAST(CAST(declarado AS DECIMAL(18,2)) AS VARCHAR) END, ' | '
          ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave) END AS txt
    FROM form_parts GROUP BY form_id) x ON x.form_id = h.form_id)"""


@register("h8_close_shift", "SELECT * FROM h8", extra_ctes=FORM_PARTS_SQL)
def h8(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_shift(forms, exp)["closings"]


@register("h8_close_shift_cierres", """
SELECT h8.form_id AS id, h8.tienda_id, h8.form_id % 50 AS usuario_id, fecha, saldo_teorico, saldo_real, diferencia, desglose_bancos,
  l.v AS observaciones
FROM h8 LEFT JOIN forms_long l ON l.form_id = h8.form_id AND l.k = 'observaciones'""", extra_ctes=FORM_PARTS_SQL)
def h8c(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_shift(forms.withColumn("usuario_id", F.col("form_id") % 50), exp)["cierres"]


@register("h8_close_shift_adjustments", """
SELECT form_id, tienda_id, CAST(NULL AS BIGINT) AS banco_id, CASE WHEN diferencia > 0 THEN 'Sobrante' ELSE 'Faltante' END AS tipo,
  diferencia AS monto_efectivo, CAST(0 AS DECIMAL(18,2)) AS monto_banco, 'Ajuste Automático por Cierre' AS referencia,
  fecha AS fecha_hora
FROM h8 WHERE ABS(diferencia) >= 0.01""", extra_ctes=FORM_PARTS_SQL)
def h8a(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_shift(forms, exp)["adjustments"]


@register("h8_close_shift_remits", """
SELECT p.form_id, h.tienda_id, CAST(p.entregado AS DECIMAL(18,2)) AS monto, h.ts AS fecha_envio, 'Pendiente' AS estado,
  CASE WHEN p.clave = 'Otros' THEN NULL ELSE TRY_CAST(p.clave AS BIGINT) END AS banco_id,
  CASE WHEN (CASE WHEN p.clave = 'Otros' THEN NULL ELSE TRY_CAST(p.clave AS BIGINT) END) IS NOT NULL
       THEN 'Entrega de banco' ELSE 'Entrega Fondo General' END AS observaciones
FROM form_parts p JOIN form_heads h ON h.form_id = p.form_id WHERE p.entregado > 0""", extra_ctes=FORM_PARTS_SQL)
def h8r(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_shift(forms, exp)["remittances"]


PREVIEW_SQL = FORMS_SQL.strip() + """,
pv AS (
  SELECT form_id, CASE WHEN k LIKE 'entrega_banco_%' THEN 'entregado' WHEN k LIKE 'banco_%' THEN 'declarado' END AS parte,
    regexp_replace(k, '^(entrega_)?banco_', '') AS clave,
    COALESCE(CAST(floor(TRY_CAST(NULLIF(regexp_extract(regexp_replace(replace(COALESCE(v, ''), ',', ''), '[^0-9.]', '', 'g'),
      '^([0-9]+[.]?[0-9]*|[.][0-9]+)', 0), '') AS DECIMAL(20,4)) * 100 + 0.5) / 100 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS monto
  FROM forms_long),
pv_bank AS (
  SELECT form_id, clave, CAST(COALESCE(SUM(CASE WHEN parte = 'declarado' THEN monto END), 0) AS DECIMAL(18,2)) AS declarado,
         CAST(COALESCE(SUM(CASE WHEN parte = 'entregado' THEN monto END), 0) AS DECIMAL(18,2)) AS entregado
  FROM pv WHERE parte IS NOT NULL GROUP BY form_id, clave)"""


@register("h10_close_preview_banks", """
SELECT form_id, clave, declarado, entregado, CAST(GREATEST(declarado - entregado, 0) AS DECIMAL(18,2)) AS resto
FROM pv_bank WHERE GREATEST(declarado - entregado, 0) > 0 OR declarado > 0""", extra_ctes=PREVIEW_SQL)
def h10b(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_preview(forms, exp)["per_bank"]


@register("h10_close_preview_totals", """
SELECT form_id, total_declarado, total_entrega, saldo_teorico, diferencia,
  CASE WHEN ABS(diferencia) < 0.01 THEN 'CUADRA' WHEN diferencia < 0 THEN 'FALTA' ELSE 'SOBRA' END AS estado,
  CAST(GREATEST(total_declarado - total_entrega, 0) AS DECIMAL(18,2)) AS saldo_final
FROM (
  SELECT p.form_id, p.td AS total_declarado, p.te AS total_entrega, e.saldo_teorico,
    CAST(floor((p.td - COALESCE(e.saldo_teorico, 0)) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS diferencia
  FROM (SELECT form_id, CAST(floor(SUM(declarado) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS td,
               CAST(floor(SUM(entregado) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS te FROM pv_bank GROUP BY form_id) p
  LEFT JOIN (SELECT DISTINCT f.form_id, t.efectivo_actual AS saldo_teorico FROM forms_long f LEFT JOIN tiendas t
             ON t.id = f.tienda_id) e ON e.form_id = p.form_id) z""", extra_ctes=PREVIEW_SQL)
def h10t(spark, d):
    forms, exp = _forms_and_expected(Ledger(spark, d))
    return HC.close_preview(forms, exp)["totals"]


@register("h1_audit_matrix_wide", """
SELECT fila, nombre, efectivo,
  MAX(CASE WHEN banco_id = 0 THEN total_banco END) AS "0", MAX(CASE WHEN banco_id = 1 THEN total_banco END) AS "1",
  MAX(CASE WHEN banco_id = 2 THEN total_banco END) AS "2", MAX(CASE WHEN banco_id = 3 THEN total_banco END) AS "3",
  MAX(CASE WHEN banco_id = 4 THEN total_banco END) AS "4"
FROM matrix GROUP BY fila, nombre, efectivo""", extra_ctes=AUDIT_CTES)
def h1w(spark, d):
    return H.audit_matrix_wide(Ledger(spark, d), [0, 1, 2, 3, 4])
