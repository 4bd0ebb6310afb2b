"""Composite analytics over stores: H1 audit matrix (flagship), H2 store
reference, H3 dashboard frames, H5/H6 opening suggestions, H11/H12 initial
configuration, H13 cashier dashboard, H15 closing reminder.

``L`` is any mapping of ledger table name -> DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.balances import OTHERS_KEY, balance_map, bank_key, map_amount, map_total, snapshot_json
from tillbook.functions.forms import melt_form
from tillbook.functions.timeparse import business_day, ts_literal
from tillbook.operators.aggregations import global_bank_position, net_since_opening, treasury_flow
from tillbook.operators.joins import id_array
from tillbook.operators.postings import posting
from tillbook.operators.setops import append_treasury_row
from tillbook.operators.windows import last_treasury_closing, latest_by_id
from tillbook.sources.schemas import MONEY_SQL

def zero():
    """decimal(18,2) zero."""
    return F.lit(0).cast(MONEY_SQL)


# Labels of the matrix rows and reference lists.
TREASURY_ROW_KEY = "tesoreria"
TREASURY_ROW_NAME = "📦 Tesorería Central"
NO_OPENING_STATE = "Sin Abrir"
NO_OPENING_SINCE = "2000-01-01 00:00:00"
REMINDER_TIME = "17:55:00"


def _m(c: Column) -> Column:
    return c.cast(MONEY_SQL)


def _bank_grid(tiendas: DataFrame, bancos: DataFrame) -> DataFrame:
    """(tienda_id, banco_id) for every store and bank: the array of bank ids
    is exploded on the store rows (no join)."""
    return tiendas.select(F.col("id").alias("tienda_id"), F.explode(id_array(bancos)).alias("banco_id"))


def _net_by_store(net: DataFrame, amount: str) -> DataFrame:
    """(_nt, _net): a store's nets as a map by bank key; it has at most one
    entry per bank and one for cash without a bank."""
    entry = F.struct(bank_key("banco_id"), F.col(amount))
    return net.groupBy(F.col("tienda_id").alias("_nt")).agg(F.map_from_entries(F.collect_list(entry)).alias("_net"))


def _opened(m: Column, key: Column) -> Column:
    return F.when(m.isNull(), zero()).otherwise(map_amount(m, key))


def _net_of(key: Column) -> Column:
    return F.coalesce(F.element_at("_net", key), zero())


def _store_parts(L) -> DataFrame:
    """One row per store with all that H1 and H2 show of it: its state, the
    Otros part, and the bank cells as an array (one per bank). The facts are
    grouped once, over bank and NULL bank together."""
    tiendas, ap, tx = L["tiendas"], L["aperturas_caja"], L["transacciones"]
    last = latest_by_id(ap, "tienda_id").select(
        F.col("tienda_id").alias("_at"), F.col("id").alias("apertura_id"), "estado",
        "saldo_inicial_efectivo", balance_map("saldos_bancos_json").alias("_map"))
    net = _net_by_store(net_since_opening(tx, ap), "neto_txn")
    t = tiendas.withColumn("_banks", id_array(L["bancos"]))
    stores = t.join(last, t.id == last._at, "left").join(net, t.id == net._nt, "left")

    def cell(bank: Column) -> Column:
        key = bank.cast("string")
        inicial, neto = _opened(F.col("_map"), key), _net_of(key)
        return F.struct(bank.alias("banco_id"), inicial.alias("inicial"), neto.alias("neto"), _m(inicial + neto).alias("total_esperado"))

    stores = stores.withColumn("celdas", F.transform("_banks", cell))
    ini_o = F.greatest(F.coalesce("saldo_inicial_efectivo", zero()) - F.when(F.col("_map").isNull(), zero()).otherwise(map_total(F.col("_map"))), zero())
    in_banks = F.aggregate("celdas", F.lit(0).cast("decimal(38,2)"), lambda acc, c: (acc + c["total_esperado"]).cast("decimal(38,2)"))
    closed = F.col("apertura_id").isNull() | (F.col("estado") == "Cerrada")
    stores = stores.select(
        F.col("id").alias("tienda_id"), F.col("nombre").alias("tienda_nombre"), "efectivo_actual", "celdas",
        F.coalesce("estado", F.lit(NO_OPENING_STATE)).alias("estado_caja"), _m(ini_o).alias("inicial_otros"),
        _m(_net_of(F.lit(OTHERS_KEY))).alias("neto_otros"), closed.alias("cerrada"), _m(in_banks).alias("total_bancos"))
    eff = F.when(F.col("cerrada"), F.coalesce("efectivo_actual", zero())) \
           .otherwise(F.col("total_bancos") + F.col("inicial_otros") + F.col("neto_otros"))
    return stores.withColumn("efectivo", _m(eff))


def treasury_cells(L, until=None) -> DataFrame:
    """Treasury row: per bank base (last snapshot) + flow since it, and the
    Otros part (NULL bank), with ``base``, ``flujo``, ``saldo``. ``until``: the balances as of that time (snapshots and flows after it are
    ignored); None = everything."""
    bancos = L["bancos"]
    ct = L["cierres_tesoreria"]
    if until is not None:
        ct = ct.filter(F.col("fecha_hora") <= ts_literal(until))
    snap = last_treasury_closing(ct)
    since = snap.select("fecha_hora").scalar()
    base = snap.select(balance_map("saldos_json").alias("_base"))
    flow = treasury_flow(L["remesas"], L["tesoreria_log"], bancos, since, until)
    # the one-row base map is attached as a scalar subquery per key
    base_map = base.select("_base").scalar()
    key = F.coalesce(F.col("banco_id").cast("string"), F.lit(OTHERS_KEY))
    cells = flow.select("banco_id", map_amount(base_map, key).alias("base"), "flujo")
    return cells.withColumn("saldo", _m(F.col("base") + F.col("flujo")))


def audit_matrix(L) -> DataFrame:
    """H1 (flagship): long form of the store x bank audit matrix plus the
    treasury row. Columns: fila, nombre, banco_id, total_banco, efectivo."""
    store_rows = _store_parts(L).select("tienda_id", "tienda_nombre", "efectivo", F.explode("celdas").alias("c")).select(
        F.col("tienda_id").cast("string").alias("fila"), F.col("tienda_nombre").alias("nombre"),
        "c.banco_id", F.col("c.total_esperado").alias("total_banco"), "efectivo")
    # the treasury's cells (one per bank) with their total, in one pass
    row = treasury_cells(L).agg(F.collect_list(F.struct("banco_id", "saldo")).alias("c"), _m(F.sum("saldo")).alias("efectivo"))
    teso = row.select("efectivo", F.explode("c").alias("c")).filter("c.banco_id is not null").select(
        F.lit(TREASURY_ROW_KEY).alias("fila"), F.lit(TREASURY_ROW_NAME).alias("nombre"), "c.banco_id",
        F.col("c.saldo").alias("total_banco"), "efectivo")
    return append_treasury_row(store_rows, teso)


def audit_matrix_wide(L, bank_ids: list[int]) -> DataFrame:
    """H1 wide form: one row per matrix row, one column per bank of
    ``bank_ids`` (a wide table has its columns named by the caller)."""
    m = audit_matrix(L)
    return m.groupBy("fila", "nombre", "efectivo").pivot("banco_id", bank_ids).agg(F.first("total_banco"))


def store_reference(L) -> DataFrame:
    """H2: per store and bank (plus Otros): opening, net, expected; store state,
    closing attached only when the till is closed, store expected total."""
    stores = _store_parts(L)
    last_ci = latest_by_id(L["cierres_caja"], "tienda_id").select(
        F.col("tienda_id").alias("_ct"), F.col("id").alias("_cid"))
    st = stores.join(last_ci, stores.tienda_id == last_ci._ct, "left").withColumn(
        "cierre_id", F.when(F.col("estado_caja") == "Cerrada", F.col("_cid")))
    otros = F.struct(F.lit(OTHERS_KEY).alias("banco_key"), F.col("inicial_otros").alias("inicial"), F.col("neto_otros").alias("neto"),
                     _m(F.col("inicial_otros") + F.col("neto_otros")).alias("total_esperado"))
    banks = F.transform("celdas", lambda c: F.struct(c["banco_id"].cast("string").alias("banco_key"), c["inicial"].alias("inicial"),
                                                     c["neto"].alias("neto"), c["total_esperado"].alias("total_esperado")))
    head = ["tienda_id", "tienda_nombre", "efectivo_actual", "estado_caja", "cierre_id", "total_esperado_tienda"]
    return (st.withColumn("total_esperado_tienda", F.col("efectivo")).select(*head, F.explode(F.concat(banks, F.array(otros))).alias("c"))
            .select(*head, "c.*"))


def dashboard_data(L) -> dict[str, DataFrame]:
    """H3: the dashboard as named frames over one plan (exchanges are reused
    by Spark when the same sub-plan appears twice)."""
    matrix = audit_matrix(L)
    return {"audit_matrix": matrix,
            "global_bank_position": global_bank_position(matrix, L["bancos"], L["saldos_bancarios"]),
            "store_reference": store_reference(L),
            "banks": L["bancos"].join(L["saldos_bancarios"].select(F.col("banco_id").alias("id"), "saldo"),
                                      "id", "left")}


def _latest_opening_by_time(ap: DataFrame) -> DataFrame:
    row = F.struct("fecha_hora", "id", "saldo_inicial_efectivo", "saldos_bancos_json")
    return ap.groupBy("tienda_id").agg(F.max(row).alias("_r")).select(
        F.col("tienda_id").alias("_at"), F.col("_r.id").alias("apertura_id"),
        F.col("_r.fecha_hora").alias("ap_ts"), F.col("_r.saldo_inicial_efectivo").alias("ap_cash"),
        balance_map(F.col("_r.saldos_bancos_json")).alias("_map"))


def _net_since_latest(L, default_since: str = NO_OPENING_SINCE) -> tuple[DataFrame, DataFrame]:
    """Per store: latest opening by time (or none) and net cash per bank since
    it (since 2000-01-01 when the store has no opening)."""
    tiendas, ap, tx = L["tiendas"], L["aperturas_caja"], L["transacciones"]
    last = _latest_opening_by_time(ap)
    st = tiendas.select(F.col("id").alias("tienda_id")).join(last, F.col("tienda_id") == last._at, "left") \
                .withColumn("_since", F.coalesce("ap_ts", F.lit(default_since).cast("timestamp_ntz")))
    bounds = st.select(F.col("tienda_id").alias("_st"), "_since")
    # the earliest bound of all stores reaches the scan as a one-row value
    recent = tx.filter(F.col("fecha_hora") >= bounds.agg(F.min("_since")).scalar())
    t = recent.join(bounds, recent.tienda_id == bounds._st, "inner").filter(F.col("fecha_hora") >= F.col("_since"))
    net = t.groupBy("tienda_id", "banco_id").agg(_m(F.sum("monto_efectivo")).alias("neto"))
    return st, net


def _per_bank_opening(L, clamp: bool) -> DataFrame:
    st, net = _net_since_latest(L)
    nets = _net_by_store(net, "neto")
    st = st.withColumn("_banks", id_array(L["bancos"]))
    g = st.join(nets, st.tienda_id == nets._nt, "left")

    def cell(key: Column, inicial: Column) -> Column:
        val = inicial + _net_of(key)
        return F.struct(key.alias("banco_key"), _m(F.greatest(val, zero()) if clamp else val).alias("monto"))

    cells = F.transform("_banks", lambda b: cell(b.cast("string"), _opened(F.col("_map"), b.cast("string"))))
    if clamp:
        sum_ini = F.when(F.col("_map").isNull(), zero()).otherwise(map_total(F.col("_map")))
        cells = F.concat(cells, F.array(cell(F.lit(OTHERS_KEY), F.greatest(F.coalesce("ap_cash", zero()) - sum_ini, zero()))))
    return g.select("tienda_id", F.explode(cells).alias("c")).select("tienda_id", "c.*")


def suggested_opening(L) -> DataFrame:
    """H5: suggested opening per store and bank (and Otros): max(0, opening +
    net since the latest opening), for all stores at once."""
    return _per_bank_opening(L, clamp=True).withColumnRenamed("monto", "sugerido")


def physical_by_bank(L) -> DataFrame:
    """H6: physical cash per store and bank: opening + net, unclamped."""
    return _per_bank_opening(L, clamp=False).withColumnRenamed("monto", "fisico")


def _first_open_till(ap: DataFrame) -> DataFrame:
    """The open till of each store (lowest id when several are open)."""
    row = F.struct("id", "saldo_inicial_efectivo", "saldos_bancos_json")
    return ap.filter(F.col("estado") == "Abierta").groupBy("tienda_id").agg(F.min(row).alias("_r")).select(
        F.col("tienda_id").alias("_at"), F.col("_r.id").alias("apertura_id"),
        F.col("_r.saldo_inicial_efectivo").alias("ap_cash"), F.col("_r.saldos_bancos_json").alias("ap_json"))


def initial_config_map(L) -> DataFrame:
    """Store x (efectivo, banks) opening matrix from open tills; stores
    without an open till read 0."""
    op = _first_open_till(L["aperturas_caja"])
    grid = _bank_grid(L["tiendas"], L["bancos"])
    g = grid.join(op, grid.tienda_id == op._at, "left")
    banks = g.select("tienda_id", F.col("banco_id").cast("string").alias("clave"),
                     F.when(F.col("ap_json").isNull(), zero())
                      .otherwise(map_amount(balance_map("ap_json"), F.col("banco_id").cast("string"))).alias("monto"))
    t = L["tiendas"].join(op, L["tiendas"].id == op._at, "left")
    cash = t.select(F.col("id").alias("tienda_id"), F.lit("efectivo").alias("clave"),
                    F.coalesce("ap_cash", zero()).alias("monto"))
    return banks.unionByName(cash)


def apply_initial_config(forms: DataFrame, L) -> DataFrame:
    """Initial-configuration forms -> new opening values of the open
    till of each store and the cash delta (new - old). Stores with no open
    till change nothing and are not returned.

    ``forms``: (form_id, form map<string,string>) with ``monto_efectivo_<t>``
    and ``monto_banco_<t>_<b>`` fields."""
    long = melt_form(forms, ["form_id"])
    cash = long.filter(F.col("campo") == "monto_efectivo").groupBy("form_id", "tienda_key") \
               .agg(F.max("monto").alias("nuevo_total"))  # a form names a store's cash once
    banks = long.filter(F.col("campo") == "monto_banco").select(
        "form_id", "tienda_key", F.col("banco_key").alias("bal_key"), F.col("monto").alias("bal_amount"))
    bj = snapshot_json(banks, ["form_id", "tienda_key"], "bal_key", "bal_amount", "nuevo_json")
    stores = long.select("form_id", "tienda_key").distinct()
    upd = (stores.join(cash, ["form_id", "tienda_key"], "left").join(bj, ["form_id", "tienda_key"], "left")
                 .select("form_id", F.col("tienda_key").try_cast("long").alias("tienda_id"),
                         F.coalesce("nuevo_total", zero()).alias("nuevo_total"),
                         F.coalesce("nuevo_json", F.lit("{}")).alias("nuevo_json")))
    op = _first_open_till(L["aperturas_caja"])
    j = upd.join(op, upd.tienda_id == op._at, "inner")
    return j.select("form_id", "tienda_id", "apertura_id", F.col("ap_cash").alias("anterior_total"),
                    "nuevo_total", "nuevo_json",
                    _m(F.col("nuevo_total") - F.coalesce("ap_cash", zero())).alias("delta_efectivo"))


def initial_config_frames(forms: DataFrame, L, at) -> dict[str, DataFrame]:
    """What the initial-configuration forms change, at the time ``at``:
    ``aperturas`` is the opening table with the new cash and bank map in the
    open till of every store that a form names, and ``postings`` adds the
    difference of the cash to the store (none where it is 0). Of several forms
    on a store the last one (by form_id) stands."""
    new = apply_initial_config(forms, L).groupBy("apertura_id", "tienda_id").agg(
        F.max(F.struct("form_id", "nuevo_total", "nuevo_json", "delta_efectivo")).alias("_n"))
    by_till = new.select(F.col("apertura_id").alias("_aid"), "_n.nuevo_total", "_n.nuevo_json")
    ap = L["aperturas_caja"]
    change = {"saldo_inicial_efectivo": "nuevo_total", "saldos_bancos_json": "nuevo_json"}
    hit = F.col("_aid").isNotNull()
    openings = ap.join(by_till, ap.id == by_till._aid, "left").select(
        *[F.when(hit, F.col(change[c])).otherwise(F.col(c)).cast(ap.schema[c].dataType).alias(c) if c in change else F.col(c) for c in ap.columns])
    moved = new.withColumn("_at", ts_literal(at)).filter(F.col("_n.delta_efectivo") != 0)
    return {"aperturas": openings, "postings": moved.select(*posting(
        "_at", "tienda", F.col("tienda_id"), None, F.col("_n.delta_efectivo"), "delta", "configuracion", "_n.form_id", 1))}


def _opening_of_day(L, day: Column | str, tz: str | None) -> DataFrame:
    """Per user the open opening (lowest id) of the business day ``day``; in
    zone ``tz`` where times are UTC instants."""
    d = day if isinstance(day, Column) else F.lit(day).cast("date")
    ap = L["aperturas_caja"].filter((F.col("estado") == "Abierta") & (business_day("fecha_hora", tz) == d))
    return ap.groupBy("usuario_id").agg(F.min(F.struct("id", "saldos_bancos_json")).alias("_r")).select(
        F.col("usuario_id").alias("_au"), F.col("_r.id").alias("apertura_id"), F.col("_r.saldos_bancos_json").alias("ap_json"))


def cashier_opening_banks(L, day: Column | str, tz: str | None = None) -> DataFrame:
    """The opening map of each cashier's opening of the day, in long form:
    (usuario_id, apertura_id, clave, monto)."""
    u = L["usuarios"].filter(F.col("rol") == "Cajero").select(F.col("id").alias("usuario_id"))
    first = _opening_of_day(L, day, tz)
    j = u.join(first, u.usuario_id == first._au, "inner").select("usuario_id", "apertura_id", F.explode(balance_map("ap_json")).alias("clave", "_v"))
    return j.select("usuario_id", "apertura_id", "clave", F.coalesce(F.col("_v").try_cast(MONEY_SQL), zero()).alias("monto"))


def cashier_dashboard(L, day: Column | str, tz: str | None = None) -> DataFrame:
    """H13 for all cashiers at once: own store cash, the open opening of that
    business day (by the cashier) and its declared total; the opening's map is
    ``cashier_opening_banks``."""
    u = L["usuarios"].filter(F.col("rol") == "Cajero")
    first = _opening_of_day(L, day, tz).select("_au", "apertura_id", map_total(balance_map("ap_json")).alias("total_apertura"))
    t = L["tiendas"].select(F.col("id").alias("_tid"), F.col("efectivo_actual").alias("saldo_anterior"))
    j = u.join(t, u.tienda_id == t._tid, "left").join(first, u.id == first._au, "left")
    return j.select(F.col("id").alias("usuario_id"), "tienda_id",
                    F.coalesce("saldo_anterior", zero()).alias("saldo_anterior"), "apertura_id",
                    F.coalesce("total_apertura", zero()).alias("total_apertura"))


def suggest_close_reminder(L, day: Column | str, tz: str | None = None) -> DataFrame:
    """Stores whose till is still open at 17:55 local on ``day``: the
    latest opening at or before that time has no closing after it (up to
    that time). ``tz``: the local zone where times are UTC instants."""
    d = day if isinstance(day, Column) else F.lit(day).cast("date")
    at = F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" " + REMINDER_TIME)))
    if tz is not None:
        at = F.convert_timezone(F.lit(tz), F.lit("UTC"), at)
    ap = L["aperturas_caja"].filter(F.col("fecha_hora") <= at)
    ci = L["cierres_caja"].filter(F.col("fecha") <= at)
    lo = ap.groupBy("tienda_id").agg(F.max(F.struct("fecha_hora", "id")).alias("_a"))
    lc = ci.groupBy(F.col("tienda_id").alias("_ct")).agg(F.max("fecha").alias("_last_close"))
    j = lo.join(lc, lo.tienda_id == lc._ct, "left")
    j = j.filter(F.col("_last_close").isNull() | (F.col("_last_close") < F.col("_a.fecha_hora")))
    return j.select("tienda_id", F.col("_a.id").alias("apertura_id"), F.col("_a.fecha_hora").alias("desde"))
