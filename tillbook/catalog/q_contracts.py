"""Group A queries (validation, repair, resets)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.operators import validation as A
from tillbook.sources.store import StoredLedger as Ledger


VALIDATE_SQL = """
SELECT 'usuarios' AS tabla, 'unique:username' AS regla, username AS clave FROM usuarios GROUP BY username HAVING COUNT(*) > 1
UNION ALL SELECT 'usuarios', 'enum:rol', CAST(id AS VARCHAR) FROM usuarios WHERE rol NOT IN ('Admin', 'Contador', 'Cajero')
UNION ALL SELECT 'usuarios', 'fk:tienda_id->tiendas', CAST(tienda_id AS VARCHAR) FROM usuarios
  WHERE tienda_id IS NOT NULL AND tienda_id NOT IN (SELECT id FROM tiendas)
UNION ALL SELECT 'transacciones', 'fk:tienda_id->tiendas', CAST(tienda_id AS VARCHAR) FROM transacciones
  WHERE tienda_id IS NOT NULL AND tienda_id NOT IN (SELECT id FROM tiendas)
UNION ALL SELECT 'transacciones', 'fk:banco_id->bancos', CAST(banco_id AS VARCHAR) FROM transacciones
  WHERE banco_id IS NOT NULL AND banco_id NOT IN (SELECT id FROM bancos)
UNION ALL SELECT 'transacciones', 'fk:usuario_id->usuarios', CAST(usuario_id AS VARCHAR) FROM transacciones
  WHERE usuario_id IS NOT NULL AND usuario_id NOT IN (SELECT id FROM usuarios)
UNION ALL SELECT 'saldos_bancarios', 'fk:banco_id->bancos', CAST(banco_id AS VARCHAR) FROM saldos_bancarios
  WHERE banco_id IS NOT NULL AND banco_id NOT IN (SELECT id FROM bancos)
UNION ALL SELECT 'comisiones', 'fk:banco_id->bancos', CAST(banco_id AS VARCHAR) FROM comisiones
  WHERE banco_id IS NOT NULL AND banco_id NOT IN (SELECT id FROM bancos)
UNION ALL SELECT 'cierres_caja', 'fk:tienda_id->tiendas', CAST(tienda_id AS VARCHAR) FROM cierres_caja
  WHERE tienda_id IS NOT NULL AND tienda_id NOT IN (SELECT id FROM tiendas)
UNION ALL SELECT 'cierres_caja', 'fk:usuario_id->usuarios', CAST(usuario_id AS VARCHAR) FROM cierres_caja
  WHERE usuario_id IS NOT NULL AND usuario_id NOT IN (SELECT id FROM usuarios)
UNION ALL SELECT 'saldos_bancarios', 'unique:banco_id', CAST(banco_id AS VARCHAR) FROM saldos_bancarios
  GROUP BY banco_id HAVING COUNT(*) > 1
UNION ALL SELECT 'tiendas', 'not_null:nombre', CAST(id AS VARCHAR) FROM tiendas WHERE nombre IS NULL
UNION ALL SELECT 'bancos', 'not_null:nombre', CAST(id AS VARCHAR) FROM bancos WHERE nombre IS NULL
UNION ALL SELECT 'usuarios', 'not_null:username', CAST(id AS VARCHAR) FROM usuarios WHERE username IS NULL
UNION ALL SELECT 'usuarios', 'not_null:rol', CAST(id AS VARCHAR) FROM usuarios WHERE rol IS NULL
UNION ALL SELECT 'transacciones', 'not_null:tipo', CAST(id AS VARCHAR) FROM transacciones WHERE tipo IS NULL"""
# every rule is broken by some rows: by the id of the row
BROKEN_SQL = {
    "tiendas": "SELECT * REPLACE (CASE WHEN id % 11 = 3 THEN NULL ELSE nombre END AS nombre) FROM tiendas",
    "bancos": "SELECT * REPLACE (CASE WHEN id % 4 = 2 THEN NULL ELSE nombre END AS nombre) FROM bancos",
    "usuarios": """SELECT * REPLACE (CASE WHEN id % 13 = 1 THEN NULL WHEN id % 13 < 4 THEN 'doble' ELSE username END AS username,
        CASE WHEN id % 17 = 2 THEN NULL WHEN id % 17 = 5 THEN 'Jefe' ELSE rol END AS rol,
        CASE WHEN id % 19 = 4 THEN 900 + id ELSE tienda_id END AS tienda_id) FROM usuarios""",
    "transacciones": """SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN NULL ELSE tipo END AS tipo,
        CASE WHEN id % 29 = 0 THEN 900 + id % 7 ELSE tienda_id END AS tienda_id,
        CASE WHEN id % 31 = 0 THEN 900 + id % 5 ELSE banco_id END AS banco_id,
        CASE WHEN id % 37 = 0 THEN -id ELSE usuario_id END AS usuario_id) FROM transacciones""",
    "saldos_bancarios": "SELECT * FROM saldos_bancarios UNION ALL SELECT * REPLACE (banco_id + CASE WHEN banco_id = 1 THEN 0 ELSE 900 END AS banco_id) FROM saldos_bancarios",
    "comisiones": "SELECT * REPLACE (CASE WHEN id % 3 = 1 THEN 900 ELSE banco_id END AS banco_id) FROM comisiones",
    "cierres_caja": """SELECT * REPLACE (CASE WHEN id % 41 = 0 THEN 901 ELSE tienda_id END AS tienda_id,
        CASE WHEN id % 43 = 0 THEN -1 ELSE usuario_id END AS usuario_id) FROM cierres_caja""",
}


def _broken(L) -> dict:
    """The same changes as frames."""
    k = F.col("id")
    out = dict(L.tables())
    changes = {
        "tiendas": {"nombre": F.when(k % 11 != 3, F.col("nombre"))}, "bancos": {"nombre": F.when(k % 4 != 2, F.col("nombre"))},
        "usuarios": {"username": F.when(k % 13 == 1, None).when(k % 13 < 4, "doble").otherwise(F.col("username")),
                     "rol": F.when(k % 17 == 2, None).when(k % 17 == 5, "Jefe").otherwise(F.col("rol")),
                     "tienda_id": F.when(k % 19 == 4, 900 + k).otherwise(F.col("tienda_id"))},
        "transacciones": {"tipo": F.when(k % 23 != 0, F.col("tipo")), "tienda_id": F.when(k % 29 == 0, 900 + k % 7).otherwise(F.col("tienda_id")),
                          "banco_id": F.when(k % 31 == 0, 900 + k % 5).otherwise(F.col("banco_id")),
                          "usuario_id": F.when(k % 37 == 0, -k).otherwise(F.col("usuario_id"))},
        "comisiones": {"banco_id": F.when(k % 3 == 1, 900).otherwise(F.col("banco_id")).cast("long")},
        "cierres_caja": {"tienda_id": F.when(k % 41 == 0, 901).otherwise(F.col("tienda_id")).cast("long"),
                         "usuario_id": F.when(k % 43 == 0, -1).otherwise(F.col("usuario_id")).cast("long")}}
    for t, columns in changes.items():
        out[t] = L[t].withColumns(columns)
    s = L["saldos_bancarios"]
    out["saldos_bancarios"] = s.unionByName(s.withColumn("banco_id", F.col("banco_id") + F.when(F.col("banco_id") == 1, 0).otherwise(900)))
    return out


def _broken_validation() -> str:
    """The checks' SQL over the changed tables."""
    sql = VALIDATE_SQL
    for t in BROKEN_SQL:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 x_{t}", sql)
    return sql


@register("a3_validate_broken_ledger", _broken_validation(),
          extra_ctes=",\n".join(f"x_{t} AS ({q})" for t, q in BROKEN_SQL.items()))
def a3_broken(spark, d):
    """Validation where rows break every rule."""
    return A.validate_ledger(_broken(Ledger(spark, d)))


@register("a3_validate_ledger", VALIDATE_SQL)
def a3(spark, d):
    return A.validate_ledger(Ledger(spark, d))


@register("a6_repair_null_bank", """
SELECT CAST(SUM(CASE WHEN tipo = 'Efectivo Entregado' AND banco_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS transacciones_corregidas,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM remesas WHERE estado IN ('Pendiente', 'Recibido') AND banco_id IS NULL) AS remesas_corregidas
FROM transacciones""")
def a6(spark, d):
    L = Ledger(spark, d)
    return A.repair_null_bank(L["transacciones"], L["remesas"], 0)["conteos"]


@register("a6_repair_null_bank_remits", """
SELECT id, tienda_id, monto, fecha_envio, estado,
  CASE WHEN estado IN ('Pendiente', 'Recibido') AND banco_id IS NULL THEN CAST(0 AS BIGINT) ELSE banco_id END AS banco_id,
  fecha_recepcion, usuario_recibe_id, observaciones FROM remesas""")
def a6r(spark, d):
    L = Ledger(spark, d)
    return A.repair_null_bank(L["transacciones"], L["remesas"], 0)["remesas"]


@register("a8_reset_treasury_remits", "SELECT * FROM remesas WHERE estado = 'Pendiente'")
def a8t(spark, d):
    return A.latest_state_reset(Ledger(spark, d).tables(), "treasury")["remesas"]


@register("a8_reset_operational_stores", """
SELECT id, nombre, CAST(0 AS DECIMAL(18,2)) AS efectivo_actual FROM tiendas""")
def a8o(spark, d):
    return A.latest_state_reset(Ledger(spark, d).tables(), "operational")["tiendas"]


from tillbook.catalog.q_composite import AUDIT_CTES  # noqa: E402
from tillbook.plans import audit as H  # noqa: E402
from tillbook.plans.treasury import close_treasury  # noqa: E402
from tillbook.sources import io as IO  # noqa: E402
from tillbook.sources.schemas import LEDGER_SCHEMAS  # noqa: E402
from tillbook.streaming.live import scratch_path  # noqa: E402


@register("a4_write_snapshot", """
SELECT fecha_hora, saldo_real AS total, CAST(fecha_hora AS DATE) AS dia FROM (
  SELECT TIMESTAMP '2024-02-01 00:00:00' AS fecha_hora, CAST(SUM(saldo) AS DECIMAL(18,2)) AS saldo_real FROM tbal) x""",
          extra_ctes=AUDIT_CTES)
def a4(spark, d):
    snap = close_treasury(Ledger(spark, d), "2024-02-01 00:00:00").select(
        "fecha_hora", F.col("total_efectivo").alias("total"))
    path = scratch_path(spark, "a4")
    for _ in range(2):  # the write is repeated, as after a failure
        IO.write_snapshot(snap, path, "fecha_hora", "corte")
    return spark.read.parquet(path).select("fecha_hora", "total", "dia")


@register("a5_read_commands", """
SELECT id, fecha_hora, tienda_id, banco_id, usuario_id, tipo, monto, referencia FROM tx_cmd""")
def a5(spark, d):
    L = Ledger(spark, d)
    cmds = L.commands()
    path = scratch_path(spark, "a5")
    IO.write_commands(cmds, path)
    return IO.read_commands(spark, path, cmds.schema).select(*cmds.columns)


@register("h3_dashboard_banks", """
SELECT b.id, b.nombre, b.color, b.estado, s.saldo FROM bancos b LEFT JOIN saldos_bancarios s ON s.banco_id = b.id""")
def h3(spark, d):
    return H.dashboard_data(Ledger(spark, d))["banks"]


@register("a3_validate_raw_commands", """
SELECT 'transacciones' AS tabla, 'fk:banco_id->bancos' AS regla, CAST(banco_id AS VARCHAR) AS clave
FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS banco_id FROM events) x
WHERE banco_id IS NOT NULL AND banco_id NOT IN (SELECT id FROM bancos)""")
def a3_raw(spark, d):
    """Validation of commands before the NULL-bank mapping: bank 5 does not
    exist, so those rows are reported as foreign-key violations."""
    L = Ledger(spark, d)
    raw = L.raw("events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("tienda_id"),
        (F.get_json_object("props", "$.k").cast("long") % 6).alias("banco_id"),
        F.col("user_id").alias("usuario_id"), F.lit("cmd").alias("tipo"))
    tables = dict(L.tables())
    tables["transacciones"] = raw
    return A.validate_ledger(tables)
