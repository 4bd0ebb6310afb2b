"""Group I queries (posting jobs) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.q_aggregations import flow_sql
from tillbook.operators import posting as I
from tillbook.operators.aggregations import treasury_flow
from tillbook.sources.store import StoredLedger as Ledger

POSTED_SQL = """
posted AS (
  SELECT id, fecha_hora, tienda_id, banco_id, tipo, monto, ce, cv,
    CAST(CASE tipo WHEN 'Depósito' THEN monto + ce WHEN 'Retiro' THEN -monto + ce WHEN 'Depósito Cuenta' THEN -monto + ce
         WHEN 'Efectivo Entregado' THEN -monto ELSE 0 END AS DECIMAL(18,2)) AS ef,
    CAST(CASE tipo WHEN 'Depósito' THEN -monto + cv WHEN 'Retiro' THEN monto + cv WHEN 'Depósito Cuenta' THEN monto + cv
         ELSE 0 END AS DECIMAL(18,2)) AS vi
  FROM tx_com WHERE monto > 0)"""


@register("i1_post_transactions", """
SELECT fecha_hora AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, ef AS monto, 'delta' AS tipo_asiento,
       'transaccion' AS fuente, id AS fuente_id, 1 AS orden FROM posted
UNION ALL
SELECT fecha_hora, 'banco', tienda_id, banco_id, vi, 'delta', 'transaccion', id, 1 FROM posted
WHERE banco_id IS NOT NULL AND vi <> 0""", extra_ctes=POSTED_SQL)
def i1(spark, d):
    L = Ledger(spark, d)
    return I.post_transactions(L.commands(), L["comisiones"])["postings"]


@register("i4_post_cash_handover", """
SELECT id, tienda_id, monto, fecha_hora AS fecha_envio, 'Pendiente' AS estado, banco_id,
       CAST(NULL AS TIMESTAMP) AS fecha_recepcion, CAST(NULL AS BIGINT) AS usuario_recibe_id,
       'Entrega desde POS' AS observaciones
FROM posted WHERE tipo = 'Efectivo Entregado'""", extra_ctes=POSTED_SQL)
def i4(spark, d):
    L = Ledger(spark, d)
    return I.post_transactions(L.commands(), L["comisiones"])["remesas"]


@register("i3_post_account_deposit", """
SELECT fecha_hora AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, CAST(-monto AS DECIMAL(18,2)) AS monto,
       'delta' AS tipo_asiento, 'deposito_cuenta' AS fuente, id AS fuente_id, 1 AS orden
FROM tx_cmd WHERE tipo = 'Depósito Cuenta' AND monto > 0
UNION ALL
SELECT fecha_hora, 'banco', tienda_id, banco_id, monto, 'delta', 'deposito_cuenta', id, 1
FROM tx_cmd WHERE tipo = 'Depósito Cuenta' AND monto > 0 AND banco_id IS NOT NULL""")
def i3(spark, d):
    cmds = Ledger(spark, d).commands().filter(F.col("tipo") == "Depósito Cuenta")
    return I.post_account_deposit(cmds)["postings"]


@register("i5_receive_remits", """
SELECT id, tienda_id, monto, fecha_envio, CASE WHEN estado = 'Pendiente' THEN 'Recibido' ELSE estado END AS estado, banco_id,
  CASE WHEN estado = 'Pendiente' THEN fecha_envio + INTERVAL 2 HOUR ELSE fecha_recepcion END AS fecha_recepcion,
  CASE WHEN estado = 'Pendiente' THEN CAST(0 AS BIGINT) ELSE usuario_recibe_id END AS usuario_recibe_id, observaciones
FROM remesas""")
def i5(spark, d):
    rem = Ledger(spark, d)["remesas"]
    cmds = rem.filter(F.col("estado") == "Pendiente").select(
        F.col("id").alias("remesa_id"), (F.col("fecha_envio") + F.expr("INTERVAL 2 HOURS")).alias("fecha"),
        F.lit(0).cast("long").alias("usuario_id"))
    return I.receive_remits(rem, cmds)


TCMD_SQL = """
tcmd AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS ts,
    CASE o_orderkey % 8 WHEN 0 THEN 'gasto_bancario' WHEN 1 THEN 'entrega_dueno' WHEN 2 THEN 'deposito_banco'
      WHEN 3 THEN 'envio_tienda' WHEN 4 THEN 'gasto_efectivo' WHEN 5 THEN 'traslado' WHEN 6 THEN 'traslado'
      ELSE 'traspaso_bolsa' END AS tipo_cmd,
    CAST(o_totalprice - 50000 AS DECIMAL(18,2)) AS monto,
    CAST(NULLIF(o_custkey % 6, 5) AS BIGINT) AS banco_origen, CAST(NULLIF(o_orderkey % 6, 5) AS BIGINT) AS banco_destino,
    CAST(o_custkey % 25 AS BIGINT) AS tienda_id,
    CASE o_custkey % 3 WHEN 0 THEN 'solo_saldo' WHEN 1 THEN 'saldo_y_efectivo' ELSE 'solo_efectivo' END AS modo,
    o_orderstatus = 'P' AS adelantado,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Orden ' || CAST(o_orderkey AS VARCHAR) END AS referencia
  FROM orders),
tv AS (
  SELECT * FROM tcmd WHERE (monto > 0 OR tipo_cmd = 'entrega_dueno')
    AND NOT (tipo_cmd = 'traslado' AND banco_origen IS NULL)
    AND NOT (tipo_cmd = 'traspaso_bolsa' AND banco_origen IS NOT DISTINCT FROM banco_destino))"""


def treasury_commands(L):
    o = L.raw("orders")
    k = F.col("o_orderkey") % 8
    kind = (F.when(k == 0, "gasto_bancario").when(k == 1, "entrega_dueno").when(k == 2, "deposito_banco")
            .when(k == 3, "envio_tienda").when(k == 4, "gasto_efectivo").when(k.isin(5, 6), "traslado")
            .otherwise("traspaso_bolsa"))
    modo = (F.when(F.col("o_custkey") % 3 == 0, "solo_saldo").when(F.col("o_custkey") % 3 == 1, "saldo_y_efectivo")
            .otherwise("solo_efectivo"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), kind.alias("tipo_cmd"),
                    (F.col("o_totalprice") - 50000).cast("decimal(18,2)").alias("monto"),
                    F.nullif(F.col("o_custkey") % 6, F.lit(5)).alias("banco_origen"),
                    F.nullif(F.col("o_orderkey") % 6, F.lit(5)).alias("banco_destino"),
                    (F.col("o_custkey") % 25).alias("tienda_id"), modo.alias("modo"),
                    (F.col("o_orderstatus") == "P").alias("adelantado"),
                    F.when(F.col("o_orderstatus") != "F",
                           F.concat(F.lit("Orden "), F.col("o_orderkey").cast("string"))).alias("referencia"))


@register("i6_i13_treasury_log", """
SELECT id AS comando_id,
  CASE tipo_cmd WHEN 'gasto_bancario' THEN 'Gasto Bancario' WHEN 'entrega_dueno' THEN 'Entrega Dueño'
    WHEN 'deposito_banco' THEN 'Depósito a Banco' WHEN 'envio_tienda' THEN 'Envío a Tienda' WHEN 'gasto_efectivo' THEN 'Entrega Dueño'
    ELSE CASE WHEN modo = 'solo_saldo' THEN 'Traslado (Solo Saldo)' ELSE 'Traslado (Efectivo)' END END AS tipo,
  monto, CASE tipo_cmd WHEN 'gasto_efectivo' THEN 'Gasto Efectivo: ' || COALESCE(referencia, 'Generico')
    WHEN 'entrega_dueno' THEN COALESCE(referencia, 'Retiro Capital')
    WHEN 'deposito_banco' THEN COALESCE(referencia, 'Depósito desde Tesorería')
    WHEN 'envio_tienda' THEN COALESCE(referencia, 'Envío de Efectivo')
    WHEN 'traslado' THEN COALESCE(referencia, 'Traslado de Fondos') ELSE referencia END AS referencia,
  ts AS fecha_hora, banco_origen AS banco_id, CASE WHEN tipo_cmd = 'deposito_banco' THEN banco_destino END AS banco_destino_id,
  (tipo_cmd = 'traslado' AND modo <> 'solo_efectivo') AS afecta_banco
FROM tv WHERE tipo_cmd IN ('gasto_bancario', 'entrega_dueno', 'envio_tienda', 'gasto_efectivo', 'traslado')
   OR (tipo_cmd = 'deposito_banco' AND NOT adelantado)
UNION ALL SELECT id, 'Entrega Dueño', monto, 'Salida Traspaso: ' || COALESCE(referencia, ''), ts, banco_origen, NULL, FALSE
  FROM tv WHERE tipo_cmd = 'traspaso_bolsa'
UNION ALL SELECT id, 'Traslado (Efectivo)', monto, 'Entrada Traspaso: ' || COALESCE(referencia, ''), ts, banco_destino, NULL, FALSE
  FROM tv WHERE tipo_cmd = 'traspaso_bolsa'
""", extra_ctes=TCMD_SQL)
def i6_13_log(spark, d):
    return I.post_treasury_commands(treasury_commands(Ledger(spark, d)))["log"]


@register("i6_i13_treasury_postings", """
SELECT ts, cuenta, tienda_id, banco_id, CAST(m AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'tesoreria' AS fuente,
       id AS fuente_id, 1 AS orden FROM (
  SELECT id, ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_origen AS banco_id, -monto AS m FROM tv
    WHERE tipo_cmd = 'gasto_bancario' AND banco_origen IS NOT NULL
  UNION ALL SELECT id, ts, 'deuda', NULL, banco_destino, monto FROM tv WHERE tipo_cmd = 'deposito_banco' AND adelantado
  UNION ALL SELECT id, ts, 'banco', NULL, banco_destino, monto FROM tv WHERE tipo_cmd = 'deposito_banco'
  UNION ALL SELECT id, ts, 'tienda', tienda_id, NULL, monto FROM tv WHERE tipo_cmd = 'envio_tienda'
  UNION ALL SELECT id, ts, 'banco', NULL, banco_origen, monto FROM tv WHERE tipo_cmd = 'traslado' AND modo <> 'solo_efectivo'
) x""", extra_ctes=TCMD_SQL)
def i6_13_post(spark, d):
    return I.post_treasury_commands(treasury_commands(Ledger(spark, d)))["postings"]


@register("i9_post_send_to_store_tx", """
SELECT id, ts AS fecha_hora, tienda_id, banco_origen AS banco_id, id % 50 AS usuario_id,
  'Resurtido Tesorería' AS tipo, monto AS monto_efectivo, CAST(0 AS DECIMAL(18,2)) AS monto_banco,
  CAST(0 AS DECIMAL(18,2)) AS comision_efectivo, CAST(0 AS DECIMAL(18,2)) AS comision_banco,
  COALESCE(referencia, 'Recibido de Tesorería') AS referencia
FROM tv WHERE tipo_cmd = 'envio_tienda'""", extra_ctes=TCMD_SQL)
def i9(spark, d):
    cmds = treasury_commands(Ledger(spark, d)).withColumn("usuario_id", F.col("id") % 50)
    return I.post_treasury_commands(cmds)["transacciones"]


@register("i8_post_bank_deposit_debts", """
SELECT id, banco_destino AS banco_id, monto, COALESCE(referencia, 'Depósito Adelantado') AS referencia, ts AS fecha_hora,
  'Pendiente' AS estado,
  CAST(NULL AS TIMESTAMP) AS fecha_pago
FROM tv WHERE tipo_cmd = 'deposito_banco' AND adelantado""", extra_ctes=TCMD_SQL)
def i8(spark, d):
    return I.post_treasury_commands(treasury_commands(Ledger(spark, d)))["depositos"]


@register("i10_pay_advances", """
SELECT id AS comando_id, 'Pago Depósito Adelantado' AS tipo, monto, COALESCE(referencia, 'Pago de Depósito Pendiente') AS referencia,
  fecha_hora + INTERVAL 30 DAY AS fecha_hora,
  banco_id, CAST(NULL AS BIGINT) AS banco_destino_id
FROM depositos_adelantados WHERE estado = 'Pendiente'""")
def i10(spark, d):
    dep = Ledger(spark, d)["depositos_adelantados"]
    cmds = dep.select(F.col("id").alias("deposito_id"), (F.col("fecha_hora") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    return I.pay_advances(dep, cmds)["log"]


STORE_XFER_SQL = """
xfer AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS ts, CAST(o_custkey % 25 AS BIGINT) AS tienda_origen,
    CAST(NULLIF(o_custkey % 6, 5) AS BIGINT) AS banco_origen, CAST(o_orderkey % 25 AS BIGINT) AS tienda_destino,
    CAST(NULLIF(o_orderkey % 6, 5) AS BIGINT) AS banco_destino, CAST(o_totalprice - 50000 AS DECIMAL(18,2)) AS monto
  FROM orders),
xv AS (SELECT * FROM xfer WHERE monto > 0 AND banco_origen IS NOT NULL AND banco_destino IS NOT NULL
       AND tienda_destino IS NOT NULL AND NOT (tienda_origen = tienda_destino AND banco_origen = banco_destino))"""


def store_transfers(L):
    o = L.raw("orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
                    (F.col("o_custkey") % 25).alias("tienda_origen"),
                    F.nullif(F.col("o_custkey") % 6, F.lit(5)).alias("banco_origen"),
                    (F.col("o_orderkey") % 25).alias("tienda_destino"),
                    F.nullif(F.col("o_orderkey") % 6, F.lit(5)).alias("banco_destino"),
                    (F.col("o_totalprice") - 50000).cast("decimal(18,2)").alias("monto"))


@register("i14_post_store_transfer", """
SELECT id AS comando_id, ts AS fecha_hora, tienda_origen AS tienda_id, banco_origen AS banco_id, 'Traspaso Salida' AS tipo,
  CAST(-monto AS DECIMAL(18,2)) AS monto_efectivo, CAST(0 AS DECIMAL(18,2)) AS monto_banco,
  'Traspaso de Efectivo (Salida)' AS referencia, id % 50 AS usuario_id FROM xv
UNION ALL
SELECT id, ts, tienda_destino, banco_destino, 'Traspaso Entrada', monto, CAST(0 AS DECIMAL(18,2)),
  'Traspaso de Efectivo (Entrada)', id % 50 FROM xv""",
          extra_ctes=STORE_XFER_SQL)
def i14(spark, d):
    cmds = store_transfers(Ledger(spark, d)).withColumn("usuario_id", F.col("id") % 50)
    return I.post_store_transfer(cmds)["transacciones"]


@register("i14_post_store_transfer_postings", """
SELECT ts, 'tienda' AS cuenta, tienda_origen AS tienda_id, CAST(NULL AS BIGINT) AS banco_id, CAST(-monto AS DECIMAL(18,2)) AS monto,
  'delta' AS tipo_asiento, 'traspaso' AS fuente, id AS fuente_id, 1 AS orden FROM xv WHERE tienda_origen <> tienda_destino
UNION ALL
SELECT ts, 'tienda', tienda_destino, NULL, monto, 'delta', 'traspaso', id, 1 FROM xv WHERE tienda_origen <> tienda_destino""",
          extra_ctes=STORE_XFER_SQL)
def i14p(spark, d):
    return I.post_store_transfer(store_transfers(Ledger(spark, d)))["postings"]


@register("i15_post_extra_income", """
SELECT id AS comando_id, ts AS fecha_hora, tienda_origen AS tienda_id, banco_destino AS banco_id, 'Ingreso Extra' AS tipo,
  monto AS monto_efectivo, CAST(0 AS DECIMAL(18,2)) AS monto_banco, 'Ingreso Extra de Efectivo' AS referencia, id % 50 AS usuario_id
FROM xfer WHERE monto > 0 AND banco_destino IS NOT NULL""", extra_ctes=STORE_XFER_SQL)
def i15(spark, d):
    return I.post_extra_income(_extra_income(Ledger(spark, d)))["transacciones"]


def _extra_income(L):
    return store_transfers(L).select("id", "ts", F.col("tienda_origen").alias("tienda_id"), F.col("banco_destino").alias("banco_id"),
                                     "monto", (F.col("id") % 50).alias("usuario_id"))


@register("i15_post_extra_income_postings", """
SELECT ts, 'tienda' AS cuenta, tienda_origen AS tienda_id, CAST(NULL AS BIGINT) AS banco_id, monto, 'delta' AS tipo_asiento,
  'ingreso_extra' AS fuente, id AS fuente_id, 1 AS orden
FROM xfer WHERE monto > 0 AND banco_destino IS NOT NULL""", extra_ctes=STORE_XFER_SQL)
def i15_postings(spark, d):
    return I.post_extra_income(_extra_income(Ledger(spark, d)))["postings"]


OPEN_FORMS_SQL = """
open_forms AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', s.d) AS BIGINT) * 1000 + s.tienda_id AS id,
         CAST(s.d AS TIMESTAMP) + INTERVAL 7 HOUR AS ts, s.tienda_id, c.usuario_id
  FROM store_days s LEFT JOIN store_cashier c ON c.tienda_id = s.tienda_id)"""


def opening_forms(L):
    """Opening form bodies per store-day: cash (with a thousands comma when
    large) and two bank fields."""
    sd = L.store_days().join(L.store_cashier(), "tienda_id", "left")
    t = F.col("tienda_id")
    cash = (t + 1) * 300 + 50
    cash_text = F.when(cash >= 1000, F.concat((cash / 1000).cast("long").cast("string"), F.lit(","),
                                              F.lpad((cash % 1000).cast("string"), 3, "0")))\
                 .otherwise(cash.cast("string"))
    form = F.create_map(F.lit("monto_efectivo"), cash_text,
                        F.lit("banco_0"), ((t + 1) * 100).cast("string"),
                        F.lit("banco_1"), F.concat(((t + 1) * 200).cast("string"), F.lit(".5")))
    return sd.select((F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long") * 1000 + t).alias("id"),
                     (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 7 HOURS")).alias("ts"), "tienda_id",
                     "usuario_id", form.alias("form"))


@register("i16_open_tills", """
SELECT id, tienda_id, usuario_id, CAST((tienda_id + 1) * 300 + 50 AS DECIMAL(18,2)) AS saldo_inicial_efectivo,
  '{"0":' || CAST((tienda_id + 1) * 100 AS VARCHAR) || ',"1":' || CAST((tienda_id + 1) * 200 AS VARCHAR) || '.5}'
    AS saldos_bancos_json, ts AS fecha_hora, 'Abierta' AS estado
FROM open_forms""", extra_ctes=OPEN_FORMS_SQL)
def i16(spark, d):
    return I.open_tills(opening_forms(Ledger(spark, d)))["aperturas"]


@register("i3_post_account_deposit_tx", """
SELECT id, fecha_hora, tienda_id, banco_id, usuario_id, 'Depósito Cuenta' AS tipo, CAST(-monto AS DECIMAL(18,2)) AS monto_efectivo,
  monto AS monto_banco, CAST(0 AS DECIMAL(18,2)) AS comision_efectivo, CAST(0 AS DECIMAL(18,2)) AS comision_banco, referencia
FROM tx_cmd WHERE tipo = 'Depósito Cuenta' AND monto > 0""")
def i3t(spark, d):
    cmds = Ledger(spark, d).commands().filter(F.col("tipo") == "Depósito Cuenta")
    return I.post_account_deposit(cmds)["transacciones"]


@register("i19_reverse_transactions", """
SELECT fecha_hora AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id,
  CAST(-monto_efectivo AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'reverso' AS fuente, id AS fuente_id, 3 AS orden
FROM transacciones WHERE tipo = 'Retiro'
UNION ALL
SELECT fecha_hora, 'banco', tienda_id, banco_id, CAST(-monto_banco AS DECIMAL(18,2)), 'delta', 'reverso', id, 3
FROM transacciones WHERE tipo = 'Retiro' AND banco_id IS NOT NULL AND monto_banco <> 0""")
def i19(spark, d):
    tx = Ledger(spark, d)["transacciones"]
    return I.reverse_transactions(tx, tx.filter(F.col("tipo") == "Retiro").select("id"))["postings"]


@register("i2_repost_transactions", """
SELECT ts, cuenta, tienda_id, banco_id, CAST(m AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'edicion' AS fuente,
       id AS fuente_id, 3 AS orden FROM (
  SELECT t.id, c.fecha_hora + INTERVAL 1 DAY AS ts, 'tienda' AS cuenta, t.tienda_id, CAST(NULL AS BIGINT) AS banco_id,
    CASE t.tipo WHEN 'Depósito' THEN (c.monto + 1) + c.ce WHEN 'Pago Caja Empresarial' THEN (c.monto + 1) + c.ce
      WHEN 'Retiro' THEN -(c.monto + 1) + c.ce WHEN 'Pago Servicio' THEN (c.monto + 1) + c.ce
      WHEN 'Depósito Cuenta' THEN -(c.monto + 1) + c.ce ELSE 0 END - t.monto_efectivo AS m
  FROM transacciones t JOIN tx_com c ON c.id = t.id
  UNION ALL
  SELECT t.id, c.fecha_hora + INTERVAL 1 DAY, 'banco', t.tienda_id, t.banco_id,
    CASE t.tipo WHEN 'Depósito' THEN -(c.monto + 1) + c.cv WHEN 'Pago Caja Empresarial' THEN -(c.monto + 1) + c.cv
      WHEN 'Retiro' THEN (c.monto + 1) + c.cv WHEN 'Pago Servicio' THEN -(c.monto + 1) + c.cv
      WHEN 'Depósito Cuenta' THEN (c.monto + 1) + c.cv WHEN 'Gasto' THEN -(c.monto + 1) ELSE 0 END - t.monto_banco
  FROM transacciones t JOIN tx_com c ON c.id = t.id WHERE t.banco_id IS NOT NULL) x""")
def i2(spark, d):
    L = Ledger(spark, d)
    edits = L.commands().select("id", (F.col("monto") + 1).cast("decimal(18,2)").alias("monto"), "referencia",
                                (F.col("fecha_hora") + F.expr("INTERVAL 1 DAYS")).alias("ts"))
    return I.repost_transactions(L["transacciones"], edits, L["comisiones"])["postings"]


GASTO_EDITS_SQL = """
gedits AS (SELECT id, CASE WHEN categoria = 'Servicios' THEN CAST(monto - 10 AS DECIMAL(18,2)) END AS nuevo,
                  fecha_hora + INTERVAL 1 DAY AS ts
           FROM gastos WHERE categoria IN ('Servicios', 'Papelería'))"""


@register("i20_adjust_expenses", """
SELECT e.ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, g.banco_id,
  CAST(g.monto - COALESCE(e.nuevo, 0) AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'gasto_ajuste' AS fuente,
  g.id AS fuente_id, 3 AS orden
FROM gastos g JOIN gedits e ON e.id = g.id""", extra_ctes=GASTO_EDITS_SQL)
def i20(spark, d):
    g = Ledger(spark, d)["gastos"]
    edits = g.filter(F.col("categoria").isin("Servicios", "Papelería")).select(
        "id", F.when(F.col("categoria") == "Servicios", (F.col("monto") - 10).cast("decimal(18,2)")).alias("monto"),
        (F.col("fecha_hora") + F.expr("INTERVAL 1 DAYS")).alias("ts"))
    return I.adjust_expenses(g, edits)["postings"]


@register("i20_adjust_expenses_table", """
SELECT g.id, g.fecha_hora, g.banco_id, COALESCE(e.nuevo, g.monto) AS monto, g.categoria, g.descripcion
FROM gastos g LEFT JOIN gedits e ON e.id = g.id WHERE NOT (e.id IS NOT NULL AND e.nuevo IS NULL)""",
          extra_ctes=GASTO_EDITS_SQL)
def i20t(spark, d):
    g = Ledger(spark, d)["gastos"]
    edits = g.filter(F.col("categoria").isin("Servicios", "Papelería")).select(
        "id", F.when(F.col("categoria") == "Servicios", (F.col("monto") - 10).cast("decimal(18,2)")).alias("monto"),
        (F.col("fecha_hora") + F.expr("INTERVAL 1 DAYS")).alias("ts"))
    return I.adjust_expenses(g, edits)["gastos"]


@register("i22_post_count_adjustment", """
SELECT COALESCE(banco_id, -1) AS comando_id, 'Ajuste de Cuadre' AS tipo,
  CAST(flujo - floor(flujo / 100) * 100 AS DECIMAL(18,2)) AS monto, 'Ajuste manual de arqueo' AS referencia,
  TIMESTAMP '2024-02-01 00:00:00' AS fecha_hora, banco_id, CAST(NULL AS BIGINT) AS banco_destino_id
FROM """ + flow_sql(None) + """ x WHERE flujo - floor(flujo / 100) * 100 <> 0""")
def i22(spark, d):
    L = Ledger(spark, d)
    # the system balance of a count is the full-history flow
    bal = treasury_flow(L["remesas"], L["tesoreria_log"], L["bancos"], None).select(
        "banco_id", F.col("flujo").alias("saldo"))
    cmds = bal.select(F.coalesce("banco_id", F.lit(-1)).alias("id"), "banco_id",
                      (F.floor(F.col("saldo") / 100) * 100).cast("decimal(18,2)").alias("contado"),
                      F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    return I.post_count_adjustment(cmds, bal)["log"]


@register("i25_reverse_debts", """
SELECT fecha_hora + INTERVAL 1 DAY AS ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_id,
  CAST(-monto AS DECIMAL(18,2)) AS monto, 'delta' AS tipo_asiento, 'reverso_deuda' AS fuente, id AS fuente_id, 3 AS orden
FROM depositos_adelantados WHERE estado = 'Pendiente' AND banco_id % 2 = 0""")
def i25(spark, d):
    dep = Ledger(spark, d)["depositos_adelantados"]
    cmds = dep.filter(F.col("estado") == "Pendiente").select(
        F.col("id").alias("deposito_id"), (F.col("banco_id") % 2 == 0).alias("revertir"),
        (F.col("fecha_hora") + F.expr("INTERVAL 1 DAYS")).alias("ts"))
    return I.reverse_debts(dep, cmds)["postings"]


@register("i26_set_bank_balance", """
SELECT banco_id, CAST(CASE WHEN banco_id = 0 THEN 5000 ELSE saldo + 100 END AS DECIMAL(18,2)) AS saldo,
       CAST(saldo_inicial + 100 AS DECIMAL(18,2)) AS saldo_inicial
FROM saldos_bancarios""")
def i26(spark, d):
    s = Ledger(spark, d)["saldos_bancarios"]
    cmds = s.select("banco_id", (F.col("saldo_inicial") + 100).alias("saldo_inicial"),
                    F.when(F.col("banco_id") == 0, F.lit(5000)).cast("decimal(18,2)").alias("saldo_actual"))
    return I.set_bank_balance(s, cmds)


@register("i26_set_bank_balance_postings", """
SELECT TIMESTAMP '2024-03-01 08:00:00' + INTERVAL 1 HOUR * banco_id AS ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_id,
  CAST(CASE WHEN banco_id = 0 THEN 5000 ELSE saldo + 100 END AS DECIMAL(18,2)) AS monto, 'set' AS tipo_asiento, 'saldo' AS fuente,
  banco_id AS fuente_id, 0 AS orden
FROM saldos_bancarios""")
def i26_postings(spark, d):
    s = Ledger(spark, d)["saldos_bancarios"]
    at = F.lit("2024-03-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("banco_id").cast("int"))
    cmds = s.select("banco_id", (F.col("saldo_inicial") + 100).alias("saldo_inicial"),
                    F.when(F.col("banco_id") == 0, F.lit(5000)).cast("decimal(18,2)").alias("saldo_actual"), at.alias("ts"))
    return I.bank_balance_postings(s, cmds)


EDITS_SQL = """
edits AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN 'nuevo ' || id WHEN id % 5 = 1 THEN 'mismo' ELSE username END AS username,
    CASE WHEN id % 2 = 0 THEN 'Contador' ELSE rol END AS rol, tienda_id, CASE WHEN id % 7 = 6 THEN 'eliminar' ELSE 'editar' END AS accion
  FROM usuarios WHERE id % 3 > 0
  UNION ALL
  SELECT 500000000 + s_suppkey, s_name, 'Cajero', s_nationkey, 'insertar' FROM supplier),
judged AS (
  SELECT e.*, CASE
    WHEN e.accion <> 'eliminar' AND (EXISTS (SELECT 1 FROM usuarios u WHERE u.username = e.username AND u.id <> e.id)
      OR e.id <> MIN(CASE WHEN e.accion <> 'eliminar' THEN e.id END) OVER (PARTITION BY e.username)) THEN 'nombre_existente'
    WHEN e.accion = 'eliminar' AND e.username = 'admin' THEN 'admin' END AS motivo
  FROM edits e)"""


def _user_edits(L):
    u = L["usuarios"]
    k = F.col("id")
    edits = u.filter(k % 3 > 0).select(
        "id", F.when(k % 5 == 0, F.concat(F.lit("nuevo "), k.cast("string"))).when(k % 5 == 1, "mismo").otherwise(F.col("username")).alias("username"),
        F.when(k % 2 == 0, "Contador").otherwise(F.col("rol")).alias("rol"), "tienda_id",
        F.when(k % 7 == 6, "eliminar").otherwise("editar").alias("accion"))
    new = L.raw("supplier").select((F.lit(500000000) + F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("username"),
                                   F.lit("Cajero").alias("rol"), F.col("s_nationkey").cast("long").alias("tienda_id"), F.lit("insertar").alias("accion"))
    return I.edit_users(u, edits.unionByName(new))


@register("i28_edit_users", """
SELECT u.id, COALESCE(j.username, u.username) AS username, COALESCE(j.rol, u.rol) AS rol,
  CASE WHEN j.id IS NULL THEN u.tienda_id WHEN j.rol = 'Cajero' THEN j.tienda_id END AS tienda_id
FROM usuarios u LEFT JOIN (SELECT * FROM judged WHERE motivo IS NULL) j ON j.id = u.id WHERE COALESCE(j.accion, '') <> 'eliminar'
UNION ALL SELECT id, username, rol, tienda_id FROM judged WHERE accion = 'insertar' AND motivo IS NULL""", extra_ctes=EDITS_SQL)
def i28_edit(spark, d):
    return _user_edits(Ledger(spark, d))["usuarios"]


@register("i28_edit_users_rejected", "SELECT id, username, accion, motivo FROM judged WHERE motivo IS NOT NULL", extra_ctes=EDITS_SQL)
def i28_rejected(spark, d):
    return _user_edits(Ledger(spark, d))["rejected"]


@register("i27_upsert_commissions", """
SELECT banco_id, tipo_transaccion, valor_efectivo, valor_virtual, valido_desde, version,
  LEAD(valido_desde) OVER (PARTITION BY banco_id, tipo_transaccion ORDER BY valido_desde, version) AS valido_hasta
FROM (
  SELECT banco_id, tipo_transaccion, valor_efectivo, valor_virtual, TIMESTAMP '1970-01-01 00:00:00' AS valido_desde, id AS version
  FROM comisiones
  UNION ALL
  SELECT CAST(r_regionkey AS BIGINT), 'Retiro', CAST(0 AS DECIMAL(18,2)), CAST(12 AS DECIMAL(18,2)),
         TIMESTAMP '2024-01-15 00:00:00', CAST(100 + r_regionkey AS BIGINT) FROM region) x""")
def i27(spark, d):
    L = Ledger(spark, d)
    ch = L.raw("region").select(F.col("r_regionkey").cast("long").alias("banco_id"), F.lit("Retiro").alias("tipo_transaccion"),
                                F.lit(0).cast("decimal(18,2)").alias("valor_efectivo"),
                                F.lit(12).cast("decimal(18,2)").alias("valor_virtual"),
                                F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("ts"),
                                (F.col("r_regionkey") + 100).cast("long").alias("id"))
    return I.upsert_commissions(L["comisiones"], ch)


@register("i28_merge_users", """
SELECT * FROM merged""", extra_ctes="""
ch AS (
  SELECT c_name AS username, 'Contador' AS rol, CAST(NULL AS BIGINT) AS tienda_id, 'actualizar' AS accion,
         CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT c_name, NULL, NULL, 'eliminar', CAST(c_custkey AS BIGINT) FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT s_name, 'Cajero', CAST(s_nationkey AS BIGINT), 'insertar', CAST(100000000 + s_suppkey AS BIGINT) FROM supplier),
merged AS (SELECT COALESCE(u.id, ch.id) AS id, COALESCE(u.username, ch.username) AS username, COALESCE(ch.rol, u.rol) AS rol,
  CASE WHEN COALESCE(ch.rol, u.rol) = 'Cajero' THEN CASE WHEN ch.accion IS NOT NULL THEN ch.tienda_id ELSE u.tienda_id END END AS tienda_id
FROM usuarios u FULL OUTER JOIN ch ON u.username = ch.username
WHERE (ch.accion IS NULL OR NOT (ch.accion = 'eliminar' AND COALESCE(u.username, ch.username) <> 'admin'))
  AND COALESCE(u.username, ch.username) IS NOT NULL)""")
def i28(spark, d):
    L = Ledger(spark, d)
    c, s = L.raw("customer"), L.raw("supplier")
    ch = (c.filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
              F.col("c_name").alias("username"), F.lit("Contador").alias("rol"), F.lit(None).cast("long").alias("tienda_id"),
              F.lit("actualizar").alias("accion"), F.col("c_custkey").alias("id"))
          .unionByName(c.filter(F.col("c_acctbal") < 0).select(
              F.col("c_name").alias("username"), F.lit(None).cast("string").alias("rol"),
              F.lit(None).cast("long").alias("tienda_id"), F.lit("eliminar").alias("accion"), F.col("c_custkey").alias("id")))
          .unionByName(s.select(F.col("s_name").alias("username"), F.lit("Cajero").alias("rol"),
                                F.col("s_nationkey").cast("long").alias("tienda_id"), F.lit("insertar").alias("accion"),
                                (F.col("s_suppkey") + 100000000).alias("id"))))
    return I.merge_users(L["usuarios"], ch)


# one query per treasury job: the job on every command of its kind
TREASURY_LOG_SQL = """
SELECT id AS comando_id,
  CASE tipo_cmd WHEN 'gasto_bancario' THEN 'Gasto Bancario' WHEN 'entrega_dueno' THEN 'Entrega Dueño'
    WHEN 'deposito_banco' THEN 'Depósito a Banco' WHEN 'envio_tienda' THEN 'Envío a Tienda' WHEN 'gasto_efectivo' THEN 'Entrega Dueño'
    ELSE CASE WHEN modo = 'solo_saldo' THEN 'Traslado (Solo Saldo)' ELSE 'Traslado (Efectivo)' END END AS tipo,
  monto, CASE tipo_cmd WHEN 'gasto_efectivo' THEN 'Gasto Efectivo: ' || COALESCE(referencia, 'Generico')
    WHEN 'entrega_dueno' THEN COALESCE(referencia, 'Retiro Capital')
    WHEN 'deposito_banco' THEN COALESCE(referencia, 'Depósito desde Tesorería')
    WHEN 'envio_tienda' THEN COALESCE(referencia, 'Envío de Efectivo')
    WHEN 'traslado' THEN COALESCE(referencia, 'Traslado de Fondos') ELSE referencia END AS referencia,
  ts AS fecha_hora, banco_origen AS banco_id, CASE WHEN tipo_cmd = 'deposito_banco' THEN banco_destino END AS banco_destino_id,
  (tipo_cmd = 'traslado' AND modo <> 'solo_efectivo') AS afecta_banco
FROM tv WHERE tipo_cmd = '{kind}'"""

for _qid, _kind in [("i6_post_bank_expense", "gasto_bancario"), ("i7_post_owner_withdrawal", "entrega_dueno"),
                    ("i11_post_transfer", "traslado"), ("i12_post_cash_expense", "gasto_efectivo")]:
    def _q(spark, d, _kind=_kind):
        c = treasury_commands(Ledger(spark, d)).filter(F.col("tipo_cmd") == _kind)
        return I.post_treasury_commands(c)["log"]
    register(_qid, TREASURY_LOG_SQL.format(kind=_kind), extra_ctes=TCMD_SQL)(_q)


@register("i13_post_pouch_transfer", """
SELECT id AS comando_id, 'Entrega Dueño' AS tipo, monto, 'Salida Traspaso: ' || COALESCE(referencia, '') AS referencia,
  ts AS fecha_hora, banco_origen AS banco_id, CAST(NULL AS BIGINT) AS banco_destino_id, FALSE AS afecta_banco
  FROM tv WHERE tipo_cmd = 'traspaso_bolsa'
UNION ALL SELECT id, 'Traslado (Efectivo)', monto, 'Entrada Traspaso: ' || COALESCE(referencia, ''), ts, banco_destino, NULL, FALSE
  FROM tv WHERE tipo_cmd = 'traspaso_bolsa'""",
          extra_ctes=TCMD_SQL)
def i13(spark, d):
    c = treasury_commands(Ledger(spark, d)).filter(F.col("tipo_cmd") == "traspaso_bolsa")
    return I.post_treasury_commands(c)["log"]


@register("i11_post_transfer_bank_legs", """
SELECT ts, 'banco' AS cuenta, CAST(NULL AS BIGINT) AS tienda_id, banco_origen AS banco_id, monto, 'delta' AS tipo_asiento,
  'tesoreria' AS fuente, id AS fuente_id, 1 AS orden FROM tv WHERE tipo_cmd = 'traslado' AND modo <> 'solo_efectivo'""",
          extra_ctes=TCMD_SQL)
def i11b(spark, d):
    c = treasury_commands(Ledger(spark, d)).filter(F.col("tipo_cmd") == "traslado")
    return I.post_treasury_commands(c)["postings"]


@register("i1_post_transactions_flagged", """
SELECT id, fecha_hora, tienda_id, banco_id, usuario_id, tipo, monto, referencia, 'tipo_sin_regla' AS motivo
FROM tx_cmd WHERE monto > 0 AND tipo NOT IN ('Depósito', 'Retiro', 'Depósito Cuenta', 'Efectivo Entregado')""")
def i1f(spark, d):
    L = Ledger(spark, d)
    return I.post_transactions(L.commands(), L["comisiones"])["flagged"]
