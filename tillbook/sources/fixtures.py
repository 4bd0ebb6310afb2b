"""Ledger tables derived from the driver's parquet tables.

Every ledger table is a lazy DataFrame over the driver tables, so the work
of every query grows with them. The same derivation is written in SQL in
``fixture_sql.py`` for the DuckDB oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.signs import EDIT_RULES, POST_RULES, signed_legs
from tillbook.sources.schemas import MONEY_SQL, conform

# The derivation constants (see FIXTURES.md section 3).
N_STORES = 25
BANK_MOD = 6            # bank = k % 6, value 5 -> NULL bank
NULL_BANK_VALUE = 5
BANK_COLOR = "#2f6f9f"
EVENT_TYPE_TO_TIPO = {
    "signup": "Depósito",
    "purchase": "Retiro",
    "view": "Depósito Cuenta",
    "click": "Efectivo Entregado",
    "error": "Pago Servicio",
}
ORDER_MOD8_TO_LOG_TYPE = {
    0: "Gasto Bancario",
    1: "Entrega Dueño",
    2: "Depósito a Banco",
    3: "Envío a Tienda",
    4: "Pago Depósito Adelantado",
    5: "Traslado (Efectivo)",
    6: "Ajuste de Cuadre",
    7: "Traslado (Efectivo)",
}
SOLO_SALDO_TYPE = "Traslado (Solo Saldo)"
# Years that get a treasury snapshot (taken on 1 January of the next year).
TREASURY_SNAPSHOT_YEARS = [1996, 1998]
# Fixture transactions use the new-transaction rules, plus the edit rule
# for the service payments the driver data contains.
FIXTURE_RULES = {**POST_RULES, "Pago Servicio": EDIT_RULES["Pago Servicio"]}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def _money(c: Column) -> Column:
    return c.cast(MONEY_SQL)


def _day_index(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long")


def remits_from_lines(li: DataFrame) -> DataFrame:
    """Remittances of the line items. A line is identified by order, line,
    part and supplier; the id is the first 60 bits of the MD5 of those."""
    received = F.col("l_returnflag") != "R"
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long").alias("id"),
        (F.col("l_suppkey") % N_STORES).alias("tienda_id"),
        _money(F.col("l_extendedprice")).alias("monto"), F.col("l_shipdate").alias("fecha_envio"),
        F.when(received, "Recibido").otherwise("Pendiente").alias("estado"),
        F.nullif(F.col("l_partkey") % BANK_MOD, F.lit(NULL_BANK_VALUE)).alias("banco_id"),
        F.when(received, F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_linenumber")))
         .alias("fecha_recepcion"),
        F.lit(None).cast("long").alias("usuario_recibe_id"),
        F.concat(F.lit("Remesa "), F.col("l_orderkey").cast("string")).alias("observaciones"))


class Ledger:
    """Lazy ledger tables over one driver directory (one DataFrame each)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = getattr(self, f"_{name}")()
        return self._cache[name]

    def tables(self) -> dict[str, DataFrame]:
        names = ["tiendas", "bancos", "saldos_bancarios", "comisiones", "usuarios",
                 "transacciones", "aperturas_caja", "cierres_caja", "remesas",
                 "tesoreria_log", "cierres_tesoreria", "depositos_adelantados", "gastos"]
        return {n: self[n] for n in names}

    # ---- dimensions -------------------------------------------------
    def _tiendas(self) -> DataFrame:
        cash = (self.raw("supplier").groupBy("s_nationkey")
                .agg(F.sum(_money(F.col("s_acctbal"))).alias("cash")))
        n = self.raw("nation")
        df = n.join(cash, n.n_nationkey == cash.s_nationkey, "left").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("nombre"),
            F.coalesce(F.col("cash"), F.lit(0)).alias("efectivo_actual"))
        return conform(df, "tiendas")

    def _bancos(self) -> DataFrame:
        r = self.raw("region")
        df = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("nombre"),
                      F.when(F.col("r_regionkey") == 4, F.lit(None)).otherwise(F.lit(BANK_COLOR))
                      .alias("color"), F.lit("Activo").alias("estado"))
        return conform(df, "bancos")

    def _saldos_bancarios(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        df = (c.join(n, c.c_nationkey == n.n_nationkey)
              .filter(F.col("n_regionkey") != 4)
              .groupBy("n_regionkey").agg(F.sum(_money(F.col("c_acctbal"))).alias("saldo"))
              .select(F.col("n_regionkey").alias("banco_id"), "saldo",
                      F.col("saldo").alias("saldo_inicial"),
                      F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("actualizado_en")))
        return conform(df, "saldos_bancarios")

    def _comisiones(self) -> DataFrame:
        r = self.raw("region")
        # The default rules of every bank (type, cash, virtual).
        retiro = r.select((F.col("r_regionkey") * 2 + 1).alias("id"),
                          F.lit("Retiro").alias("tipo_transaccion"),
                          F.col("r_regionkey").alias("banco_id"),
                          F.lit(0).alias("valor_efectivo"), F.lit(10).alias("valor_virtual"))
        pago = r.select((F.col("r_regionkey") * 2 + 2).alias("id"),
                        F.lit("Pago Servicio").alias("tipo_transaccion"),
                        F.col("r_regionkey").alias("banco_id"),
                        F.lit(8).alias("valor_efectivo"), F.lit(-8).alias("valor_virtual"))
        return conform(retiro.unionByName(pago), "comisiones")

    def _usuarios(self) -> DataFrame:
        c = self.raw("customer")
        rol = (F.when(F.col("c_mktsegment") == "MACHINERY", "Admin")
               .when(F.col("c_mktsegment") == "BUILDING", "Contador").otherwise("Cajero"))
        df = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                      rol.alias("rol"),
                      F.when(rol == "Cajero", F.col("c_nationkey")).alias("tienda_id"))
        return conform(df, "usuarios")

    # ---- facts ------------------------------------------------------
    def commands(self) -> DataFrame:
        """Transaction commands (before posting) derived from ``events``."""
        return commands_from_events(self.raw("events"))

    def _transacciones(self) -> DataFrame:
        return post_fixture_transactions(self.commands(), self["comisiones"])

    def store_days(self) -> DataFrame:
        """Distinct (store, business day) with the store's first and last day."""
        from pyspark.sql import Window as W
        d = (self.commands().select("tienda_id", F.to_date("fecha_hora").alias("d")).distinct())
        w = W.partitionBy("tienda_id")
        return d.select("tienda_id", "d", F.min("d").over(w).alias("first_d"),
                        F.max("d").over(w).alias("last_d"))

    def store_cashier(self) -> DataFrame:
        return (self["usuarios"].filter(F.col("rol") == "Cajero")
                .groupBy("tienda_id").agg(F.min("id").alias("usuario_id")))

    def _aperturas_caja(self) -> DataFrame:
        t = F.col("tienda_id")
        v0 = (t + 1) * 100
        v1 = (t + 1) * 200
        json = (F.when(t % 11 == 10, F.lit("no-json"))
                .when(t % 7 == 3, F.concat(F.lit('{"0": '), v0.cast("string"), F.lit(', "1": "'),
                                           v1.cast("string"), F.lit('"}')))
                .otherwise(F.concat(F.lit('{"0": '), v0.cast("string"), F.lit(', "1": '),
                                    v1.cast("string"), F.lit("}"))))
        sd = self.store_days().filter(~((t % 5 == 0) & (F.col("d") == F.col("first_d"))))
        df = sd.join(self.store_cashier(), "tienda_id", "left").select(
            (_day_index(F.col("d")) * 1000 + t).alias("id"), "tienda_id", "usuario_id",
            ((t + 1) * 300 + 50).alias("saldo_inicial_efectivo"),
            json.alias("saldos_bancos_json"),
            (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS")).alias("fecha_hora"),
            F.when((F.col("d") == F.col("last_d")) & (t % 3 != 0), "Abierta")
             .otherwise("Cerrada").alias("estado"))
        return conform(df, "aperturas_caja")

    def closing_days(self) -> DataFrame:
        """(store, day, seq): one closing per store-day, two on stores % 4 = 0."""
        t = F.col("tienda_id")
        seq = F.explode(F.when(t % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        return self.store_days().select("tienda_id", "d", seq.alias("seq"))

    def _cierres_caja(self) -> DataFrame:
        t = F.col("tienda_id")
        di = _day_index(F.col("d"))
        off = (F.when((di + t) % 3 == 0, F.lit(5)).when((di + t) % 3 == 1, F.lit(-5))
               .otherwise(F.lit(0)))
        d0 = (t + 1) * 100 + off
        d1 = (t + 1) * 200
        dec_text = F.concat(F.lit("0: L "), d0.cast("string"), F.lit(".00 | 1: L "),
                            d1.cast("string"), F.lit(".00"))
        dlv_text = F.when(t % 2 == 0, F.concat(F.lit(" || ENTREGA: 0: L "), ((t + 1) * 10).cast("string"),
                                               F.lit(".00 / Otros: L 5.00"))).otherwise(F.lit(""))
        df = self.closing_days().join(self.store_cashier(), "tienda_id", "left").select(
            ((di * 1000 + t) * 10 + F.col("seq")).alias("id"), "tienda_id", "usuario_id",
            (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("seq") * 2 + 18))
            .alias("fecha"),
            ((t + 1) * 300).alias("saldo_teorico"), ((t + 1) * 300 + off).alias("saldo_real"),
            off.alias("diferencia"), F.concat(dec_text, dlv_text).alias("desglose_bancos"),
            F.lit(None).cast("string").alias("observaciones"))
        return conform(df, "cierres_caja")

    def _remesas(self) -> DataFrame:
        from_lines = remits_from_lines(self.raw("lineitem"))
        odd = F.col("id") % 2 == 1
        handovers = self.commands().filter(F.col("tipo") == "Efectivo Entregado").select(
            "id", "tienda_id", "monto", F.col("fecha_hora").alias("fecha_envio"),
            F.when(odd, "Recibido").otherwise("Pendiente").alias("estado"), "banco_id",
            F.when(odd, F.col("fecha_hora") + F.expr("INTERVAL 1 HOURS")).alias("fecha_recepcion"),
            F.when(odd, F.col("usuario_id")).alias("usuario_recibe_id"),
            F.lit("Entrega desde POS").alias("observaciones"))
        return conform(from_lines.unionByName(handovers), "remesas")

    def _tesoreria_log(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        tipo = F.when(k % 16 == 7, F.lit(SOLO_SALDO_TYPE))
        for m, name in ORDER_MOD8_TO_LOG_TYPE.items():
            tipo = tipo.when(k % 8 == m, F.lit(name))
        df = o.select(
            k.alias("id"), tipo.alias("tipo"), _money(F.col("o_totalprice")).alias("monto"),
            F.concat(F.lit("Orden "), k.cast("string")).alias("referencia"),
            F.col("o_orderdate").alias("fecha_hora"),
            F.nullif(F.col("o_custkey") % BANK_MOD, F.lit(NULL_BANK_VALUE)).alias("banco_id"),
            F.when(k % 8 == 2, k % 5).alias("banco_destino_id"))
        return conform(df, "tesoreria_log")

    def _cierres_tesoreria(self) -> DataFrame:
        """Treasury snapshots derived from the log: one per snapshot year, at
        1 January of the next year, holding per bank (and Otros) the sum of
        that year's owner withdrawals as balance JSON."""
        from tillbook.functions.balances import bank_key, snapshot_json
        log = self["tesoreria_log"].withColumn("_y", F.year("fecha_hora"))
        per = (log.filter((F.col("tipo") == "Entrega Dueño") & F.col("_y").isin(*TREASURY_SNAPSHOT_YEARS))
               .groupBy("_y", bank_key("banco_id").alias("_k")).agg(F.sum("monto").cast(MONEY_SQL).alias("_v")))
        js = snapshot_json(per, ["_y"], "_k", "_v")
        tot = per.groupBy("_y").agg(F.sum("_v").cast(MONEY_SQL).alias("total_efectivo"))
        df = js.join(tot, "_y").select(
            F.col("_y").cast("long").alias("id"),
            F.make_timestamp_ntz(F.col("_y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("fecha_hora"),
            "saldos_json", "total_efectivo", F.lit("Corte").alias("observaciones"))
        return conform(df, "cierres_tesoreria")

    def _depositos_adelantados(self) -> DataFrame:
        o = self.raw("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        paid = F.col("o_orderstatus") != "P"
        df = o.select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("banco_id"),
            _money(F.col("o_totalprice")).alias("monto"),
            F.concat(F.lit("Adelanto "), F.col("o_orderkey").cast("string")).alias("referencia"),
            F.col("o_orderdate").alias("fecha_hora"),
            F.when(paid, "Pagado").otherwise("Pendiente").alias("estado"),
            F.when(paid, F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("fecha_pago"))
        return conform(df, "depositos_adelantados")

    def _gastos(self) -> DataFrame:
        o = self.raw("orders").filter(F.col("o_orderpriority") == "2-HIGH")
        cat = (F.when(F.col("o_orderstatus") == "F", "Servicios")
               .when(F.col("o_orderstatus") == "O", "Papelería").otherwise(F.lit("")))
        desc = F.when(F.col("o_custkey") % 3 == 0, F.lit(None).cast("string")) \
                .otherwise(F.concat(F.lit("Pedido "), F.col("o_orderkey").cast("string")))
        df = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fecha_hora"),
                      (F.col("o_orderkey") % 5).alias("banco_id"),
                      _money(F.col("o_totalprice")).alias("monto"),
                      cat.alias("categoria"), desc.alias("descripcion"))
        return conform(df, "gastos")


def commands_from_events(e: DataFrame) -> DataFrame:
    """Transaction commands from an ``events`` frame (batch or stream)."""
    tipo = None
    for et, t in EVENT_TYPE_TO_TIPO.items():
        cond = F.col("event_type") == et
        tipo = F.when(cond, t) if tipo is None else tipo.when(cond, t)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("fecha_hora"),
        (F.col("user_id") % N_STORES).alias("tienda_id"),
        F.nullif(k % BANK_MOD, F.lit(NULL_BANK_VALUE)).alias("banco_id"),
        F.col("user_id").alias("usuario_id"), tipo.alias("tipo"),
        _money(F.col("value")).alias("monto"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("referencia"))


def post_fixture_transactions(cmds: DataFrame, com: DataFrame) -> DataFrame:
    """Fixture transactions: commands posted with the fixture sign rules."""
    from tillbook.operators.joins import with_commission
    cmd = with_commission(cmds, com)
    cash, bank = signed_legs(F.col("tipo"), F.col("monto"), F.col("com_ef"), F.col("com_vi"), FIXTURE_RULES)
    df = cmd.select("id", "fecha_hora", "tienda_id", "banco_id", "usuario_id", "tipo",
                    cash.alias("monto_efectivo"), bank.alias("monto_banco"),
                    F.col("com_ef").alias("comision_efectivo"), F.col("com_vi").alias("comision_banco"),
                    "referencia")
    return conform(df, "transacciones")


def load_fixture_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return Ledger(spark, sf_dir)
