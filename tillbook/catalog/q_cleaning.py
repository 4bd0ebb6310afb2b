"""Group B queries (column functions) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.functions import balances as B
from tillbook.functions.breakdown import breakdown_long, build_breakdown
from tillbook.functions.forms import melt_form
from tillbook.functions.money import parse_money, round_cents
from tillbook.functions.text import compose_description
from tillbook.functions.timeparse import business_day, normalize_ts
from tillbook.operators.aggregations import net_since_opening
from tillbook.sources.store import StoredLedger as Ledger

MONEY_TEXT_SQL = """
money_text AS (
  SELECT l_returnflag, l_linenumber % 4 AS variante,
    CASE l_linenumber % 4
      WHEN 0 THEN 'L ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || 'abc'
      WHEN 2 THEN '- L ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
      ELSE ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS texto
  FROM lineitem),
parsed AS (
  SELECT l_returnflag, variante,
    TRY_CAST(NULLIF(regexp_extract(ltrim(replace(texto, ',', '')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DECIMAL(18,2)) AS p_commas,
    TRY_CAST(NULLIF(regexp_extract(ltrim(regexp_replace(texto, '[^0-9.\\-]', '', 'g')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DECIMAL(18,2)) AS p_strict,
    TRY_CAST(NULLIF(regexp_extract(ltrim(texto), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DECIMAL(18,2)) AS p_raw
  FROM money_text)"""


@register("b1_parse_money", """
SELECT l_returnflag, variante, COUNT(*) AS n,
  CAST(SUM(p_commas) AS DECIMAL(18,2)) AS suma_commas, COUNT(p_commas) AS ok_commas,
  CAST(SUM(p_strict) AS DECIMAL(18,2)) AS suma_strict, COUNT(p_strict) AS ok_strict,
  CAST(SUM(p_raw) AS DECIMAL(18,2)) AS suma_raw, COUNT(p_raw) AS ok_raw
FROM parsed GROUP BY l_returnflag, variante""", extra_ctes=MONEY_TEXT_SQL)
def b1(spark, d):
    li = Ledger(spark, d).raw("lineitem")
    v = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    var = F.col("l_linenumber") % 4
    text = (F.when(var == 0, F.concat(F.lit("L "), v)).when(var == 1, F.concat(v, F.lit("abc")))
            .when(var == 2, F.concat(F.lit("- L "), v)).otherwise(F.concat(F.lit(" "), v)))
    p = li.select("l_returnflag", var.alias("variante"), text.alias("texto"))
    p = p.select("l_returnflag", "variante", parse_money("texto", "commas").alias("c"),
                 parse_money("texto", "strict").alias("s"), parse_money("texto", "raw").alias("r"))
    return p.groupBy("l_returnflag", "variante").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").cast("decimal(18,2)").alias("suma_commas"),
        F.count("c").alias("ok_commas"), F.sum("s").cast("decimal(18,2)").alias("suma_strict"),
        F.count("s").alias("ok_strict"), F.sum("r").cast("decimal(18,2)").alias("suma_raw"),
        F.count("r").alias("ok_raw"))


def closing_forms(L):
    """Closing form bodies (map<string,string>) derived from the closing days:
    declared per bank (one with thousands commas), Otros, deliveries on
    even stores."""
    k = L.closing_days()
    t = F.col("tienda_id")
    big = (t + 1) * 200
    comma_text = F.when(big >= 1000, F.concat((big / 1000).cast("long").cast("string"), F.lit(","),
                                              F.lpad((big % 1000).cast("string"), 3, "0"), F.lit(".50"))) \
                  .otherwise(F.concat(big.cast("string"), F.lit(".50")))
    entries = [F.struct(F.lit("banco_0").alias("k"), ((t + 1) * 100).cast("string").alias("v")),
               F.struct(F.lit("banco_1").alias("k"), comma_text.alias("v")),
               F.struct(F.lit("banco_Otros").alias("k"), F.lit("25").alias("v")),
               F.struct(F.lit("observaciones").alias("k"), F.lit("ok").alias("v"))]
    dl = F.array(F.struct(F.lit("entrega_banco_0").alias("k"), ((t + 1) * 10).cast("string").alias("v")),
                 F.struct(F.lit("entrega_banco_Otros").alias("k"), F.lit("5").alias("v")),
                 F.struct(F.lit("entrega_banco_1").alias("k"), F.lit("0").alias("v")))
    arr = F.when(t % 2 == 0, F.concat(F.array(*entries), dl)).otherwise(F.array(*entries))
    form_id = (F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long") * 1000 + t) * 10 + F.col("seq")
    ts = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("seq") * 2 + 18)
    return k.select(form_id.alias("form_id"), "tienda_id", ts.alias("ts"), F.map_from_entries(arr).alias("form"))


FORMS_SQL = """
forms_long AS (
  SELECT (CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) * 1000 + tienda_id) * 10 + seq AS form_id,
         tienda_id, CAST(d AS TIMESTAMP) + to_hours(CAST(seq * 2 + 18 AS BIGINT)) AS ts, e.k, e.v
  FROM closing_days, LATERAL (
    SELECT 'banco_0' AS k, CAST((tienda_id + 1) * 100 AS VARCHAR) AS v
    UNION ALL SELECT 'banco_1', CASE WHEN (tienda_id + 1) * 200 >= 1000
        THEN CAST(((tienda_id + 1) * 200) // 1000 AS VARCHAR) || ',' || lpad(CAST(((tienda_id + 1) * 200) % 1000 AS VARCHAR), 3, '0') || '.50'
        ELSE CAST((tienda_id + 1) * 200 AS VARCHAR) || '.50' END
    UNION ALL SELECT 'banco_Otros', '25'
    UNION ALL SELECT 'observaciones', 'ok'
    UNION ALL SELECT 'entrega_banco_0', CAST((tienda_id + 1) * 10 AS VARCHAR) WHERE tienda_id % 2 = 0
    UNION ALL SELECT 'entrega_banco_Otros', '5' WHERE tienda_id % 2 = 0
    UNION ALL SELECT 'entrega_banco_1', '0' WHERE tienda_id % 2 = 0) e),
forms_melt AS (
  SELECT form_id, tienda_id, ts,
    CASE WHEN k LIKE 'entrega_banco_%' THEN 'entrega_banco' WHEN k LIKE 'banco_%' THEN 'banco' END AS campo,
    CAST(NULL AS VARCHAR) AS tienda_key,
    CASE WHEN k LIKE 'entrega_banco_%' THEN substr(k, 15) ELSE substr(k, 7) END AS banco_key,
    COALESCE(TRY_CAST(NULLIF(regexp_extract(ltrim(replace(v, ',', '')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DECIMAL(18,2)),
             CAST(0 AS DECIMAL(18,2))) AS monto
  FROM forms_long WHERE k LIKE 'banco_%' OR k LIKE 'entrega_banco_%')"""


@register("b2_melt_form", "SELECT form_id, campo, tienda_key, banco_key, monto FROM forms_melt",
          extra_ctes=FORMS_SQL)
def b2(spark, d):
    return melt_form(closing_forms(Ledger(spark, d)), ["form_id"])


JSON_EXPLODE = """
SELECT a.id, u.k AS bal_key, TRY_CAST(json_extract_string(a.jj, '$."' || u.k || '"') AS DECIMAL(18,2)) AS bal_amount
FROM (SELECT *, CASE WHEN json_valid(saldos_bancos_json) THEN saldos_bancos_json ELSE '{}' END AS jj
      FROM aperturas_caja) a, LATERAL (SELECT unnest(json_keys(a.jj)) AS k) u"""


@register("b3_explode_balances", JSON_EXPLODE)
def b3(spark, d):
    ap = Ledger(spark, d)["aperturas_caja"].select("id", "saldos_bancos_json")
    return B.explode_balances(ap, "saldos_bancos_json").select("id", "bal_key", "bal_amount")


BREAKDOWN_SQL = r"""
bd_parts AS (
  SELECT id, split_part(COALESCE(desglose_bancos, ''), '||', 1) AS dec_text,
         CASE WHEN position('ENTREGA:' IN COALESCE(split_part(desglose_bancos, '||', 2), '')) > 0
              THEN replace(split_part(desglose_bancos, '||', 2), 'ENTREGA:', '') ELSE '' END AS dlv_text
  FROM cierres_caja),
bd_entries AS (
  SELECT id, 'declarado' AS parte, trim(e) AS s FROM bd_parts, unnest(string_split(dec_text, '|')) t(e)
  UNION ALL
  SELECT id, 'entregado', trim(e) FROM bd_parts, unnest(string_split(dlv_text, '/')) t(e)),
bd_long AS (
  SELECT id, parte, trim(regexp_extract(s, '^(.+?):\s*L\s*([\d.,]+)$', 1)) AS clave,
         COALESCE(TRY_CAST(replace(regexp_extract(s, '^(.+?):\s*L\s*([\d.,]+)$', 2), ',', '') AS DECIMAL(18,2)),
                  CAST(0 AS DECIMAL(18,2))) AS monto
  FROM bd_entries WHERE regexp_matches(s, '^(.+?):\s*L\s*([\d.,]+)$'))"""


@register("b4a_parse_breakdown", "SELECT * FROM bd_long", extra_ctes=BREAKDOWN_SQL)
def b4a(spark, d):
    return breakdown_long(Ledger(spark, d)["cierres_caja"], ["id"])


@register("b4b_build_breakdown", r"""
SELECT id, CASE WHEN COUNT(*) FILTER (WHERE entregado > 0) > 0
  THEN string_agg(CASE WHEN declarado IS NOT NULL THEN clave || ': L ' || printf('%.2f', declarado) END, ' | '
                  ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave)
       || ' || ENTREGA: ' ||
       string_agg(CASE WHEN entregado > 0 THEN clave || ': L ' || printf('%.2f', entregado) END, ' / '
                  ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave)
  ELSE string_agg(CASE WHEN declarado IS NOT NULL THEN clave || ': L ' || printf('%.2f', declarado) END, ' | '
                  ORDER BY CASE WHEN regexp_matches(clave, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(clave AS BIGINT), clave)
  END AS desglose_bancos
FROM (SELECT id, clave, SUM(CASE WHEN parte = 'declarado' THEN monto END) AS declarado,
             SUM(CASE WHEN parte = 'entregado' THEN monto END) AS entregado
      FROM bd_long GROUP BY id, clave) g
GROUP BY id""", extra_ctes=BREAKDOWN_SQL)
def b4b(spark, d):
    long = breakdown_long(Ledger(spark, d)["cierres_caja"], ["id"])
    per_key = long.groupBy("id", "clave").agg(
        F.sum(F.when(F.col("parte") == "declarado", F.col("monto"))).alias("declarado"),
        F.sum(F.when(F.col("parte") == "entregado", F.col("monto"))).alias("entregado"))
    return build_breakdown(per_key, ["id"])


TS_TEXT_SQL = """
ts_text AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '-06:00' ELSE '' END AS texto
  FROM events),
ts_norm AS (
  SELECT event_id, CASE WHEN texto LIKE '%-06:00' THEN CAST(substr(texto, 1, 19) AS TIMESTAMP) + INTERVAL 6 HOUR
                        ELSE CAST(texto AS TIMESTAMP) END AS ts_utc
  FROM ts_text)"""


def _ts_text(L):
    e = L.raw("events")
    txt = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                   F.when(F.col("event_id") % 2 == 0, F.lit("-06:00")).otherwise(F.lit("")))
    return e.select("event_id", txt.alias("texto"))


@register("b5_normalize_ts", "SELECT * FROM ts_norm", extra_ctes=TS_TEXT_SQL)
def b5(spark, d):
    t = _ts_text(Ledger(spark, d))
    return t.select("event_id", normalize_ts("texto").alias("ts_utc"))


@register("b6_business_day", """
SELECT CAST(ts_utc - INTERVAL 6 HOUR AS DATE) AS dia, COUNT(*) AS n FROM ts_norm GROUP BY 1""",
          extra_ctes=TS_TEXT_SQL)
def b6(spark, d):
    t = _ts_text(Ledger(spark, d))
    n = t.select(normalize_ts("texto").alias("ts_utc"))
    return n.groupBy(business_day("ts_utc").alias("dia")).agg(F.count(F.lit(1)).alias("n"))


@register("b7_nullable_bank", """
SELECT id, parte, clave, CASE WHEN clave = '' OR clave = 'Otros' THEN NULL ELSE TRY_CAST(clave AS BIGINT) END AS banco_id
FROM bd_long""", extra_ctes=BREAKDOWN_SQL)
def b7(spark, d):
    long = breakdown_long(Ledger(spark, d)["cierres_caja"], ["id"])
    return long.select("id", "parte", "clave", B.nullable_bank("clave").alias("banco_id"))


@register("b8_compose_description", """
SELECT id, CASE WHEN descripcion IS NOT NULL AND descripcion <> '' THEN COALESCE(categoria, 'undefined') || ' - ' || descripcion
                ELSE categoria END AS descripcion_final,
       COALESCE(NULLIF(CASE WHEN descripcion IS NOT NULL AND descripcion <> '' THEN COALESCE(categoria, 'undefined') || ' - ' || descripcion
                ELSE categoria END, ''), 'Gasto') AS descripcion_o_defecto
FROM gastos""")
def b8(spark, d):
    g = Ledger(spark, d)["gastos"]
    return g.select("id", compose_description("categoria", "descripcion").alias("descripcion_final"),
                    compose_description("categoria", "descripcion", "Gasto").alias("descripcion_o_defecto"))


JS_NUM = ("CASE WHEN CAST({v} AS VARCHAR) LIKE '%.%' THEN regexp_replace(regexp_replace(CAST({v} AS VARCHAR), '0+$', ''), "
          "'[.]$', '') ELSE CAST({v} AS VARCHAR) END")


@register("b9_snapshot_json", f"""
SELECT tienda_id, '{{' || string_agg('"' || k || '":' || {JS_NUM.format(v='neto_txn')}, ','
   ORDER BY CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(k AS BIGINT), k) || '}}' AS saldos_json
FROM (SELECT t.tienda_id, COALESCE(CAST(t.banco_id AS VARCHAR), 'Otros') AS k,
             CAST(SUM(t.monto_efectivo) AS DECIMAL(18,2)) AS neto_txn
      FROM transacciones t JOIN (SELECT tienda_id, MAX(fecha_hora) AS ultima FROM aperturas_caja GROUP BY tienda_id) a
      ON t.tienda_id = a.tienda_id WHERE t.fecha_hora >= a.ultima GROUP BY t.tienda_id, t.banco_id) x
GROUP BY tienda_id""")
def b9(spark, d):
    L = Ledger(spark, d)
    net = net_since_opening(L["transacciones"], L["aperturas_caja"]).withColumn("k", B.bank_key("banco_id"))
    return B.snapshot_json(net, ["tienda_id"], "k", "neto_txn")


@register("b10_round_cents", """
SELECT event_id, CAST(floor(CAST(value AS DECIMAL(18,2)) * 0.125 * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS redondeado,
       CAST(floor(-CAST(value AS DECIMAL(18,2)) * 0.125 * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS redondeado_neg
FROM events""")
def b10(spark, d):
    e = Ledger(spark, d).raw("events")
    x = F.col("value").cast("decimal(18,2)") * F.lit(0.125).cast("decimal(4,3)")
    return e.select("event_id", round_cents(x).alias("redondeado"), round_cents(-x).alias("redondeado_neg"))
