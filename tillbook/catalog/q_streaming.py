"""Group J queries: each runs a real stream (file source, availableNow) to
its sink under the checkpoint dir and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.q_posting import POSTED_SQL
from tillbook.sources.fixtures import commands_from_events, remits_from_lines
from tillbook.sources.store import StoredLedger as Ledger
from tillbook.streaming import live as J
from tillbook.streaming.keyed import pending_events


def _events_stream(spark, d):
    return J.table_stream(spark, d, "events")


@register("j3_stream_post", """
SELECT fecha_hora AS ts, 'tienda' AS cuenta, tienda_id, CAST(NULL AS BIGINT) AS banco_id, ef AS monto, 'delta' AS tipo_asiento,
       'transaccion' AS fuente, id AS fuente_id, 1 AS orden FROM posted
UNION ALL
SELECT fecha_hora, 'banco', tienda_id, banco_id, vi, 'delta', 'transaccion', id, 1 FROM posted
WHERE banco_id IS NOT NULL AND vi <> 0""", extra_ctes=POSTED_SQL)
def j3(spark, d):
    L = Ledger(spark, d)
    out = J.scratch_path(spark, "j3")
    q = J.run_post(commands_from_events(_events_stream(spark, d)), L["comisiones"], out)
    q.awaitTermination()
    return spark.read.parquet(out + "/postings").drop("lote")


@register("j1_stream_net_by_store_bank", """
SELECT tienda_id, banco_id, CAST(SUM(monto_efectivo) AS DECIMAL(18,2)) AS neto_txn
FROM transacciones JOIN (SELECT tienda_id, MAX(fecha_hora) AS desde FROM aperturas_caja GROUP BY ALL) USING (tienda_id)
WHERE fecha_hora >= desde GROUP BY ALL""")
def j1(spark, d):
    from tillbook.sources.fixtures import post_fixture_transactions
    L = Ledger(spark, d)
    tx = post_fixture_transactions(commands_from_events(_events_stream(spark, d)), L["comisiones"])
    out = J.scratch_path(spark, "j1")
    J.run_net(tx, J.ledger_stream(spark, L.path, "aperturas_caja"), out).awaitTermination()
    return J.current_net(spark, out)


def _sent_and_received(spark, d):
    """Remittances as the dashboard's poll sees them: every one is sent, and
    those received take themselves away again."""
    cmds = commands_from_events(_events_stream(spark, d)).filter(F.col("tipo") == "Efectivo Entregado")
    odd = F.col("id") % 2 == 1
    rem = cmds.select("id", F.col("fecha_hora").alias("fecha_envio"),
                      F.when(odd, "Recibido").otherwise("Pendiente").alias("estado"))
    lines = remits_from_lines(J.table_stream(spark, d, "lineitem"))
    return pending_events(rem.unionByName(lines.select(*rem.columns)), "remesa", "fecha_envio")


@register("j2_stream_pending_changes", """
SELECT CAST(0 AS BIGINT) AS epoch, COUNT(*) AS pendientes, arg_max(id, (fecha_envio, id)) AS primer_id
FROM remesas WHERE estado = 'Pendiente'""")
def j2(spark, d):
    out = J.scratch_path(spark, "j2")
    J.run_pending_changes(_sent_and_received(spark, d), out).awaitTermination()
    return spark.read.parquet(out + "/changes").drop("lote", "clase")


@register("j2_stream_pending_classes", """
SELECT CAST(0 AS BIGINT) AS epoch, clase, COUNT(*) AS pendientes, arg_max(id, (fecha, id)) AS primer_id FROM (
  SELECT 'remesa' AS clase, id, fecha_envio AS fecha FROM remesas WHERE estado = 'Pendiente'
  UNION ALL
  SELECT 'deuda', id, fecha_hora FROM depositos_adelantados WHERE estado = 'Pendiente') GROUP BY ALL""")
def j2_classes(spark, d):
    L = Ledger(spark, d)
    debts = pending_events(J.ledger_stream(spark, L.path, "depositos_adelantados"), "deuda", "fecha_hora")
    out = J.scratch_path(spark, "j2c")
    J.run_pending_changes(_sent_and_received(spark, d).unionByName(debts), out).awaitTermination()
    return spark.read.parquet(out + "/changes").drop("lote")


@register("j4_stream_daily_flow", """
SELECT date_trunc('day', fecha_hora) AS dia_inicio, tipo,
  CAST(SUM(CASE WHEN monto_efectivo > 0 THEN monto_efectivo ELSE 0 END) AS DECIMAL(18,2)) AS entrada,
  CAST(SUM(CASE WHEN monto_efectivo < 0 THEN -monto_efectivo ELSE 0 END) AS DECIMAL(18,2)) AS salida, COUNT(*) AS ops
FROM transacciones
WHERE date_trunc('day', fecha_hora) + INTERVAL 1 DAY <= (SELECT MAX(fecha_hora) - INTERVAL 1 HOUR FROM transacciones)
GROUP BY 1, 2""")
def j4(spark, d):
    from tillbook.sources.fixtures import post_fixture_transactions
    L = Ledger(spark, d)
    tx = post_fixture_transactions(commands_from_events(_events_stream(spark, d)), L["comisiones"])
    out = J.scratch_path(spark, "j4")
    q = J.run_daily_flow(tx, out, "1 hour")
    q.awaitTermination()
    return spark.read.parquet(out + "/flujo").drop("lote")
