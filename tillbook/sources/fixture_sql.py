"""The fixture derivation of ``fixtures.py`` as DuckDB SQL (oracle side).

``with_fixtures(body)`` prefixes a query with CTEs named after the ledger
tables; the driver tables are the pre-registered views.
"""

from __future__ import annotations

FIXTURE_CTES = r"""
tiendas AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS id, n.n_name AS nombre,
         CAST(COALESCE(s.cash, 0) AS DECIMAL(18,2)) AS efectivo_actual
  FROM nation n LEFT JOIN (
    SELECT s_nationkey, SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS cash FROM supplier GROUP BY s_nationkey
  ) s ON n.n_nationkey = s.s_nationkey),
bancos AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS nombre,
         CASE WHEN r_regionkey = 4 THEN NULL ELSE '#2f6f9f' END AS color, 'Activo' AS estado
  FROM region),
saldos_bancarios AS (
  SELECT CAST(n.n_regionkey AS BIGINT) AS banco_id,
         CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS saldo,
         CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS saldo_inicial,
         TIMESTAMP '2024-01-01 00:00:00' AS actualizado_en
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE n.n_regionkey <> 4 GROUP BY n.n_regionkey),
comisiones AS (
  SELECT CAST(r_regionkey * 2 + 1 AS BIGINT) AS id, 'Retiro' AS tipo_transaccion,
         CAST(r_regionkey AS BIGINT) AS banco_id, CAST(0 AS DECIMAL(18,2)) AS valor_efectivo,
         CAST(10 AS DECIMAL(18,2)) AS valor_virtual FROM region
  UNION ALL
  SELECT CAST(r_regionkey * 2 + 2 AS BIGINT), 'Pago Servicio', CAST(r_regionkey AS BIGINT),
         CAST(8 AS DECIMAL(18,2)), CAST(-8 AS DECIMAL(18,2)) FROM region),
usuarios AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS username,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Admin'
              WHEN c_mktsegment = 'BUILDING' THEN 'Contador' ELSE 'Cajero' END AS rol,
         CASE WHEN c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' THEN NULL
              ELSE CAST(c_nationkey AS BIGINT) END AS tienda_id
  FROM customer),
tx_cmd AS (
  SELECT CAST(event_id AS BIGINT) AS id, ts AS fecha_hora, CAST(user_id % 25 AS BIGINT) AS tienda_id,
         CAST(NULLIF(CAST(json_extract_string(props, '$.k') AS BIGINT) % 6, 5) AS BIGINT) AS banco_id,
         CAST(user_id AS BIGINT) AS usuario_id,
         CASE event_type WHEN 'signup' THEN 'Depósito' WHEN 'purchase' THEN 'Retiro'
              WHEN 'view' THEN 'Depósito Cuenta' WHEN 'click' THEN 'Efectivo Entregado'
              WHEN 'error' THEN 'Pago Servicio' END AS tipo,
         CAST(value AS DECIMAL(18,2)) AS monto,
         'EV-' || CAST(event_id AS VARCHAR) AS referencia
  FROM events),
rule1 AS (
  SELECT banco_id, tipo_transaccion, arg_min(valor_efectivo, id) AS ce, arg_min(valor_virtual, id) AS cv
  FROM comisiones GROUP BY banco_id, tipo_transaccion),
tx_com AS (
  SELECT c.*, COALESCE(r.ce, CAST(0 AS DECIMAL(18,2))) AS ce, COALESCE(r.cv, CAST(0 AS DECIMAL(18,2))) AS cv
  FROM tx_cmd c LEFT JOIN rule1 r ON r.banco_id = c.banco_id AND r.tipo_transaccion = c.tipo),
transacciones AS (
  SELECT id, fecha_hora, tienda_id, banco_id, usuario_id, tipo,
    CAST(CASE tipo WHEN 'Depósito' THEN monto + ce WHEN 'Retiro' THEN -monto + ce
         WHEN 'Depósito Cuenta' THEN -monto + ce WHEN 'Efectivo Entregado' THEN -monto
         WHEN 'Pago Servicio' THEN monto + ce ELSE 0 END AS DECIMAL(18,2)) AS monto_efectivo,
    CAST(CASE tipo WHEN 'Depósito' THEN -monto + cv WHEN 'Retiro' THEN monto + cv
         WHEN 'Depósito Cuenta' THEN monto + cv WHEN 'Efectivo Entregado' THEN 0
         WHEN 'Pago Servicio' THEN -monto + cv ELSE 0 END AS DECIMAL(18,2)) AS monto_banco,
    CAST(ce AS DECIMAL(18,2)) AS comision_efectivo, CAST(cv AS DECIMAL(18,2)) AS comision_banco,
    referencia
  FROM tx_com),
store_days AS (
  SELECT tienda_id, d, MIN(d) OVER (PARTITION BY tienda_id) AS first_d,
         MAX(d) OVER (PARTITION BY tienda_id) AS last_d
  FROM (SELECT DISTINCT tienda_id, CAST(fecha_hora AS DATE) AS d FROM tx_cmd) x),
store_cashier AS (
  SELECT tienda_id, MIN(id) AS usuario_id FROM usuarios WHERE rol = 'Cajero' GROUP BY tienda_id),
aperturas_caja AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', s.d) AS BIGINT) * 1000 + s.tienda_id AS id,
         s.tienda_id, c.usuario_id,
         CAST((s.tienda_id + 1) * 300 + 50 AS DECIMAL(18,2)) AS saldo_inicial_efectivo,
         CASE WHEN s.tienda_id % 11 = 10 THEN 'no-json'
              WHEN s.tienda_id % 7 = 3 THEN '{"0": ' || CAST((s.tienda_id + 1) * 100 AS VARCHAR) || ', "1": "' || CAST((s.tienda_id + 1) * 200 AS VARCHAR) || '"}'
              ELSE '{"0": ' || CAST((s.tienda_id + 1) * 100 AS VARCHAR) || ', "1": ' || CAST((s.tienda_id + 1) * 200 AS VARCHAR) || '}' END AS saldos_bancos_json,
         CAST(s.d AS TIMESTAMP) + INTERVAL 8 HOUR AS fecha_hora,
         CASE WHEN s.d = s.last_d AND s.tienda_id % 3 <> 0 THEN 'Abierta' ELSE 'Cerrada' END AS estado
  FROM store_days s LEFT JOIN store_cashier c ON s.tienda_id = c.tienda_id
  WHERE NOT (s.tienda_id % 5 = 0 AND s.d = s.first_d)),
closing_days AS (
  SELECT s.tienda_id, s.d, q.seq FROM store_days s
  JOIN (SELECT 0 AS seq UNION ALL SELECT 1) q ON q.seq = 0 OR s.tienda_id % 4 = 0),
cierres_caja AS (
  SELECT (CAST(date_diff('day', DATE '1970-01-01', k.d) AS BIGINT) * 1000 + k.tienda_id) * 10 + k.seq AS id,
         k.tienda_id, c.usuario_id,
         CAST(k.d AS TIMESTAMP) + to_hours(CAST(k.seq * 2 + 18 AS BIGINT)) AS fecha,
         CAST((k.tienda_id + 1) * 300 AS DECIMAL(18,2)) AS saldo_teorico,
         CAST((k.tienda_id + 1) * 300 + k.off AS DECIMAL(18,2)) AS saldo_real,
         CAST(k.off AS DECIMAL(18,2)) AS diferencia,
         '0: L ' || CAST((k.tienda_id + 1) * 100 + k.off AS VARCHAR) || '.00 | 1: L '
           || CAST((k.tienda_id + 1) * 200 AS VARCHAR) || '.00'
           || CASE WHEN k.tienda_id % 2 = 0 THEN ' || ENTREGA: 0: L ' || CAST((k.tienda_id + 1) * 10 AS VARCHAR)
                   || '.00 / Otros: L 5.00' ELSE '' END AS desglose_bancos,
         CAST(NULL AS VARCHAR) AS observaciones
  FROM (SELECT *, CASE (CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) + tienda_id) % 3
                   WHEN 0 THEN 5 WHEN 1 THEN -5 ELSE 0 END AS off FROM closing_days) k
  LEFT JOIN store_cashier c ON k.tienda_id = c.tienda_id),
remesas AS (
  SELECT CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT) AS id,
         CAST(l_suppkey % 25 AS BIGINT) AS tienda_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS monto, l_shipdate AS fecha_envio,
         CASE WHEN l_returnflag <> 'R' THEN 'Recibido' ELSE 'Pendiente' END AS estado,
         CAST(NULLIF(l_partkey % 6, 5) AS BIGINT) AS banco_id,
         CASE WHEN l_returnflag <> 'R' THEN l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) END AS fecha_recepcion,
         CAST(NULL AS BIGINT) AS usuario_recibe_id,
         'Remesa ' || CAST(l_orderkey AS VARCHAR) AS observaciones
  FROM lineitem
  UNION ALL
  SELECT id, tienda_id, monto, fecha_hora,
         CASE WHEN id % 2 = 1 THEN 'Recibido' ELSE 'Pendiente' END, banco_id,
         CASE WHEN id % 2 = 1 THEN fecha_hora + INTERVAL 1 HOUR END,
         CASE WHEN id % 2 = 1 THEN usuario_id END, 'Entrega desde POS'
  FROM tx_cmd WHERE tipo = 'Efectivo Entregado'),
tesoreria_log AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         CASE WHEN o_orderkey % 16 = 7 THEN 'Traslado (Solo Saldo)'
              WHEN o_orderkey % 8 = 0 THEN 'Gasto Bancario' WHEN o_orderkey % 8 = 1 THEN 'Entrega Dueño'
              WHEN o_orderkey % 8 = 2 THEN 'Depósito a Banco' WHEN o_orderkey % 8 = 3 THEN 'Envío a Tienda'
              WHEN o_orderkey % 8 = 4 THEN 'Pago Depósito Adelantado' WHEN o_orderkey % 8 = 6 THEN 'Ajuste de Cuadre'
              ELSE 'Traslado (Efectivo)' END AS tipo,
         CAST(o_totalprice AS DECIMAL(18,2)) AS monto, 'Orden ' || CAST(o_orderkey AS VARCHAR) AS referencia,
         o_orderdate AS fecha_hora, CAST(NULLIF(o_custkey % 6, 5) AS BIGINT) AS banco_id,
         CASE WHEN o_orderkey % 8 = 2 THEN CAST(o_orderkey % 5 AS BIGINT) END AS banco_destino_id
  FROM orders),
cierres_tesoreria AS (
  SELECT CAST(y AS BIGINT) AS id, CAST(NULL AS BIGINT) AS usuario_id, make_timestamp(y + 1, 1, 1, 0, 0, 0) AS fecha_hora,
    '{' || string_agg('"' || k || '":' || CASE WHEN CAST(v AS VARCHAR) LIKE '%.%'
        THEN regexp_replace(regexp_replace(CAST(v AS VARCHAR), '0+$', ''), '[.]$', '') ELSE CAST(v AS VARCHAR) END, ','
      ORDER BY CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(k AS BIGINT), k) || '}' AS saldos_json,
    CAST(SUM(v) AS DECIMAL(18,2)) AS total_efectivo, 'Corte' AS observaciones
  FROM (SELECT year(fecha_hora) AS y, COALESCE(CAST(banco_id AS VARCHAR), 'Otros') AS k,
               CAST(SUM(monto) AS DECIMAL(18,2)) AS v
        FROM tesoreria_log WHERE tipo = 'Entrega Dueño' AND year(fecha_hora) IN (1996, 1998) GROUP BY 1, 2) x
  GROUP BY y),
depositos_adelantados AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 5 AS BIGINT) AS banco_id,
         CAST(o_totalprice AS DECIMAL(18,2)) AS monto, 'Adelanto ' || CAST(o_orderkey AS VARCHAR) AS referencia,
         o_orderdate AS fecha_hora,
         CASE WHEN o_orderstatus <> 'P' THEN 'Pagado' ELSE 'Pendiente' END AS estado,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 7 DAY END AS fecha_pago
  FROM orders WHERE o_orderpriority = '1-URGENT'),
gastos AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS fecha_hora, CAST(o_orderkey % 5 AS BIGINT) AS banco_id,
         CAST(o_totalprice AS DECIMAL(18,2)) AS monto,
         CASE WHEN o_orderstatus = 'F' THEN 'Servicios' WHEN o_orderstatus = 'O' THEN 'Papelería' ELSE '' END AS categoria,
         CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'Pedido ' || CAST(o_orderkey AS VARCHAR) END AS descripcion
  FROM orders WHERE o_orderpriority = '2-HIGH')
"""


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    """``WITH <fixture CTEs>[, extra] <body>``."""
    ctes = FIXTURE_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
