"""Group I: write routes re-aimed as bulk jobs. Each job takes a frame of
commands and returns new fact rows and postings (see ``postings.py``) as
DataFrames; nothing is updated in place, so a job can be re-run on the same
input and its output written to a new path. Commands that name the same row
take effect in their order (``commands.py``); a repeat of a command that can
act only once does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.functions.balances import snapshot_json
from tillbook.functions.money import money_or_zero, parse_money
from tillbook.functions.signs import EDIT_RULES, POST_RULES, signed_legs
from tillbook.operators.commands import in_sequence, one_per_target
from tillbook.operators.filters import split_valid
from tillbook.operators.joins import with_commission
from tillbook.operators.postings import posting, store_and_bank_legs
from tillbook.sources.schemas import MONEY_SQL, conform

# Generated texts and types of the write routes.
POS_HANDOVER_NOTE = "Entrega desde POS"
RESTOCK_TYPE = "Resurtido Tesorería"
CASH_EXPENSE_PREFIX = "Gasto Efectivo: "
TRANSFER_DEFAULT_REF = "Traslado de Fondos"
STORE_TRANSFER_DEFAULT_REF = "Traspaso de Efectivo"
EXTRA_INCOME_DEFAULT_REF = "Ingreso Extra de Efectivo"
COUNT_ADJ_DEFAULT_REF = "Ajuste manual de arqueo"
# Default reference text per treasury command kind (when the command has none).
TREASURY_DEFAULT_REF = {
    "entrega_dueno": "Retiro Capital",
    "deposito_banco": "Depósito desde Tesorería",
    "deposito_adelantado": "Depósito Adelantado",
    "envio_tienda": "Envío de Efectivo",
    "restock": "Recibido de Tesorería",
    "traslado": "Traslado de Fondos",
    "gasto_efectivo": "Generico",
    "pago_adelanto": "Pago de Depósito Pendiente",
}
POUCH_OUT_PREFIX = "Salida Traspaso: "
POUCH_IN_PREFIX = "Entrada Traspaso: "
LOG_TYPE_BY_KIND = {
    "gasto_bancario": "Gasto Bancario",
    "entrega_dueno": "Entrega Dueño",
    "deposito_banco": "Depósito a Banco",
    "envio_tienda": "Envío a Tienda",
    "gasto_efectivo": "Entrega Dueño",
}


def _user(cmds: DataFrame) -> Column:
    """The user who gave the command; NULL where commands name none."""
    return (F.col("usuario_id") if "usuario_id" in cmds.columns else F.lit(None)).cast("long").alias("usuario_id")


def _zero() -> Column:
    return F.lit(0).cast(MONEY_SQL)


def _neg(c: Column) -> Column:
    return (-c).cast(MONEY_SQL)


def post_transactions(cmds: DataFrame, com: DataFrame) -> dict[str, DataFrame]:
    """I1 (+I4): transaction commands -> transactions, store-cash and bank
    postings, and a Pendiente remittance for each cash handover.

    ``cmds``: id, fecha_hora, tienda_id, banco_id, usuario_id, tipo, monto,
    referencia. Amounts that are not > 0 are rejected."""
    valid, rejected = split_valid(cmds, "monto")
    c = with_commission(valid, com)
    cash, bank = signed_legs(F.col("tipo"), F.col("monto"), F.col("com_ef"), F.col("com_vi"), POST_RULES)
    c = c.withColumn("monto_efectivo", cash).withColumn("monto_banco", bank)
    tx = conform(c.withColumnRenamed("com_ef", "comision_efectivo").withColumnRenamed("com_vi", "comision_banco"),
                 "transacciones")
    legs = store_and_bank_legs(c, "fecha_hora", F.col("monto_efectivo"), F.col("monto_banco"), "transaccion", "id", 1)
    rem = c.filter(F.col("tipo") == "Efectivo Entregado").select(
        "id", "tienda_id", "monto", F.col("fecha_hora").alias("fecha_envio"), F.lit("Pendiente").alias("estado"),
        "banco_id", F.lit(POS_HANDOVER_NOTE).alias("observaciones"))
    flagged = valid.filter(~F.col("tipo").isin(list(POST_RULES))).withColumn("motivo", F.lit("tipo_sin_regla"))
    return {"transacciones": tx, "postings": legs, "remesas": conform(rem, "remesas"), "rejected": rejected,
            "flagged": flagged}


def post_account_deposit(cmds: DataFrame) -> dict[str, DataFrame]:
    """Account deposit: store cash -m, bank +m, no commission."""
    valid, rejected = split_valid(cmds, "monto")
    p = valid.select(F.col("id"), F.col("fecha_hora"), F.col("tienda_id"), F.col("banco_id"),
                     F.explode(F.array(
                         F.struct(F.lit("tienda").alias("cuenta"), _neg(F.col("monto")).alias("m")),
                         F.struct(F.lit("banco").alias("cuenta"), F.col("monto").alias("m")))).alias("leg"))
    p = p.filter((F.col("leg.cuenta") == "tienda") | F.col("banco_id").isNotNull())
    out = p.select(F.col("fecha_hora").alias("ts"), F.col("leg.cuenta").alias("cuenta"), "tienda_id",
                   F.when(F.col("leg.cuenta") == "banco", F.col("banco_id")).cast("long").alias("banco_id"),
                   F.col("leg.m").cast(MONEY_SQL).alias("monto"), F.lit("delta").alias("tipo_asiento"),
                   F.lit("deposito_cuenta").alias("fuente"), F.col("id").alias("fuente_id"), F.lit(1).alias("orden"))
    tx = valid.select("id", "fecha_hora", "tienda_id", "banco_id", "usuario_id", F.lit("Depósito Cuenta").alias("tipo"),
                      _neg(F.col("monto")).alias("monto_efectivo"), F.col("monto").cast(MONEY_SQL).alias("monto_banco"),
                      "referencia")
    return {"postings": out, "transacciones": conform(tx, "transacciones"), "rejected": rejected}


def receive_remits(rem: DataFrame, cmds: DataFrame) -> DataFrame:
    """Remittances named by ``cmds`` (remesa_id, fecha, usuario_id) become
    'Recibido' with time and user; the state is not checked (as the source
    update does not check it), so the last command on a remittance stands.
    Other remittances are unchanged."""
    c = one_per_target(cmds.select("remesa_id", "fecha", "usuario_id"), "remesa_id", "fecha", "last").select(F.col("remesa_id").alias("_rid"), F.col("fecha").alias("_f"), F.col("usuario_id").alias("_u"))
    j = rem.join(c, rem.id == c._rid, "left")
    hit = F.col("_rid").isNotNull()
    return j.select(*[F.when(hit, F.lit("Recibido")).otherwise(F.col("estado")).alias(x) if x == "estado"
                      else F.when(hit, F.col("_f")).otherwise(F.col(x)).alias(x) if x == "fecha_recepcion"
                      else F.when(hit, F.col("_u")).otherwise(F.col(x)).alias(x) if x == "usuario_recibe_id"
                      else F.col(x) for x in rem.columns])


def post_treasury_commands(cmds: DataFrame) -> dict[str, DataFrame]:
    """Treasury commands -> treasury log rows (the treasury
    cash is the flow of the log), bank / store / debt postings, restock
    transactions and advance-deposit debts.

    ``cmds``: id, ts, tipo_cmd, monto, banco_origen, banco_destino, tienda_id,
    modo (traslado), adelantado (deposito_banco), referencia."""
    k = F.col("tipo_cmd")
    # owner withdrawals are not validated by the source route (parseFloat || 0)
    owner = cmds.filter(k == "entrega_dueno").withColumn("monto", F.coalesce("monto", F.lit(0)).cast(MONEY_SQL))
    valid, rejected = split_valid(cmds.filter(k != "entrega_dueno"), "monto")
    valid = valid.unionByName(owner)
    m = F.col("monto")
    # bank transfers need a bank; sends need a store; same-pouch moves are ignored
    bad = (((k == "traslado") & F.col("banco_origen").isNull()) | ((k == "envio_tienda") & F.col("tienda_id").isNull()))
    rejected = rejected.unionByName(valid.filter(bad).withColumn("motivo", F.lit("faltan_datos")))
    v = valid.filter(~bad & ~((k == "traspaso_bolsa") & F.col("banco_origen").eqNullSafe(F.col("banco_destino"))))
    is_adv = (k == "deposito_banco") & F.col("adelantado")
    tl_type = None
    for kind, t in LOG_TYPE_BY_KIND.items():
        cond = (k == kind) & ~is_adv
        tl_type = F.when(cond, F.lit(t)) if tl_type is None else tl_type.when(cond, F.lit(t))
    tl_type = tl_type.when((k == "traslado") & (F.col("modo") == "solo_saldo"), F.lit("Traslado (Solo Saldo)")) \
                     .when(k == "traslado", F.lit("Traslado (Efectivo)"))
    given = F.col("referencia")
    dflt = lambda kind: F.coalesce(F.nullif(given, F.lit("")), F.lit(TREASURY_DEFAULT_REF[kind]))
    ref = (F.when(k == "gasto_efectivo", F.concat(F.lit(CASH_EXPENSE_PREFIX), dflt("gasto_efectivo")))
           .when(k.isin("entrega_dueno", "deposito_banco", "envio_tienda", "traslado"),
                 F.when(k == "entrega_dueno", dflt("entrega_dueno")).when(k == "deposito_banco", dflt("deposito_banco"))
                  .when(k == "envio_tienda", dflt("envio_tienda")).otherwise(dflt("traslado")))
           .otherwise(given))
    touches_bank = (k == "traslado") & (F.col("modo") != "solo_efectivo")
    log_leg = F.struct(tl_type.alias("tipo"), F.col("banco_origen").alias("banco_id"),
                       F.when(k == "deposito_banco", F.col("banco_destino")).alias("banco_destino_id"),
                       ref.alias("referencia"), touches_bank.alias("afecta_banco"))
    pouch_ref = F.coalesce(given, F.lit(""))
    bolsa_out = F.struct(F.lit("Entrega Dueño").alias("tipo"), F.col("banco_origen").alias("banco_id"),
                         F.lit(None).cast("long").alias("banco_destino_id"),
                         F.concat(F.lit(POUCH_OUT_PREFIX), pouch_ref).alias("referencia"),
                         F.lit(False).alias("afecta_banco"))
    bolsa_in = F.struct(F.lit("Traslado (Efectivo)").alias("tipo"), F.col("banco_destino").alias("banco_id"),
                        F.lit(None).cast("long").alias("banco_destino_id"),
                        F.concat(F.lit(POUCH_IN_PREFIX), pouch_ref).alias("referencia"),
                        F.lit(False).alias("afecta_banco"))
    logs = F.when(k == "traspaso_bolsa", F.array(bolsa_out, bolsa_in)) \
            .when(tl_type.isNotNull(), F.array(log_leg)).otherwise(F.array())
    log = v.select("id", "ts", "monto", F.explode(logs).alias("l")).select(
        F.col("id").alias("comando_id"), F.col("l.tipo").alias("tipo"), "monto", F.col("l.referencia").alias("referencia"),
        F.col("ts").alias("fecha_hora"), F.col("l.banco_id").alias("banco_id"),
        F.col("l.banco_destino_id").alias("banco_destino_id"), F.col("l.afecta_banco").alias("afecta_banco"))
    # non-treasury legs: (cuenta, tienda, banco, signed amount)
    leg = lambda cuenta, tienda, banco, amount: F.struct(
        F.lit(cuenta).alias("cuenta"), tienda.cast("long").alias("tienda_id"), banco.cast("long").alias("banco_id"),
        amount.cast(MONEY_SQL).alias("m"))
    none = F.lit(None)
    legs = (F.when((k == "gasto_bancario") & F.col("banco_origen").isNotNull(),
                   F.array(leg("banco", none, F.col("banco_origen"), _neg(m))))
            .when(is_adv, F.array(leg("deuda", none, F.col("banco_destino"), m), leg("banco", none, F.col("banco_destino"), m)))
            .when(k == "deposito_banco", F.array(leg("banco", none, F.col("banco_destino"), m)))
            .when(k == "envio_tienda", F.array(leg("tienda", F.col("tienda_id"), none, m)))
            .when((k == "traslado") & (F.col("modo") != "solo_efectivo"), F.array(leg("banco", none, F.col("banco_origen"), m)))
            .otherwise(F.array()))
    p = v.select("id", "ts", F.explode(legs).alias("g")).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("g.cuenta").alias("cuenta"), F.col("g.tienda_id").alias("tienda_id"),
        F.col("g.banco_id").alias("banco_id"), F.col("g.m").alias("monto"), F.lit("delta").alias("tipo_asiento"),
        F.lit("tesoreria").alias("fuente"), F.col("id").alias("fuente_id"), F.lit(1).alias("orden"))
    restock = v.filter(k == "envio_tienda").select(
        F.col("id"), F.col("ts").alias("fecha_hora"), "tienda_id", F.col("banco_origen").alias("banco_id"),
        F.lit(RESTOCK_TYPE).alias("tipo"), F.col("monto").alias("monto_efectivo"), _zero().alias("monto_banco"),
        dflt("restock").alias("referencia"), _user(cmds))
    debts = v.filter(is_adv).select(F.col("id"), F.col("banco_destino").alias("banco_id"), "monto",
                                    dflt("deposito_adelantado").alias("referencia"),
                                    F.col("ts").alias("fecha_hora"), F.lit("Pendiente").alias("estado"))
    return {"log": log, "postings": p, "transacciones": conform(restock, "transacciones"),
            "depositos": conform(debts, "depositos_adelantados"), "rejected": rejected}


def pay_advances(dep: DataFrame, cmds: DataFrame) -> dict[str, DataFrame]:
    """Pay pending advance deposits named by ``cmds`` (deposito_id, ts):
    log 'Pago Depósito Adelantado' (treasury outflow), debt -> 'Pagado'.
    Commands on debts that are not pending do nothing, so the first command
    on a debt pays it."""
    c = one_per_target(cmds.select("deposito_id", "ts"), "deposito_id", "ts").select(F.col("deposito_id").alias("_did"), F.col("ts").alias("_ts"))
    pend = dep.filter(F.col("estado") == "Pendiente")
    j = pend.join(c, pend.id == c._did, "inner")
    log = j.select(F.col("id").alias("comando_id"), F.lit("Pago Depósito Adelantado").alias("tipo"), "monto",
                   F.coalesce(F.nullif(F.col("referencia"), F.lit("")), F.lit(TREASURY_DEFAULT_REF["pago_adelanto"]))
                   .alias("referencia"),
                   F.col("_ts").alias("fecha_hora"), "banco_id",
                   F.lit(None).cast("long").alias("banco_destino_id"))
    paid = dep.join(c, dep.id == c._did, "left").select(
        *[F.when(F.col("_did").isNotNull() & (F.col("estado") == "Pendiente"), F.lit("Pagado")).otherwise(F.col("estado"))
          .alias(x) if x == "estado" else
          F.when(F.col("_did").isNotNull() & (F.col("estado") == "Pendiente"), F.col("_ts")).otherwise(F.col(x)).alias(x)
          if x == "fecha_pago" else F.col(x) for x in dep.columns])
    return {"log": log, "depositos": paid}


def post_store_transfer(cmds: DataFrame) -> dict[str, DataFrame]:
    """Store-to-store transfer on a (store, bank) pair: 'Traspaso Salida'
    at the source, 'Traspaso Entrada' at the target; the store cash moves
    only when the stores differ. Both banks and the target store are
    required; the same bank in the same store is rejected. ``cmds``: id, ts,
    tienda_origen, banco_origen, tienda_destino, banco_destino, monto
    [, referencia, usuario_id]."""
    valid, rejected = split_valid(cmds, "monto", required=["banco_origen", "banco_destino", "tienda_destino"])
    same_slot = F.col("tienda_origen").eqNullSafe(F.col("tienda_destino")) & \
        F.col("banco_origen").eqNullSafe(F.col("banco_destino"))
    rejected = rejected.unionByName(valid.filter(same_slot).withColumn("motivo", F.lit("mismo_origen_destino")))
    v = valid.filter(~same_slot)
    out = F.struct(F.lit("Traspaso Salida").alias("tipo"), F.col("tienda_origen").alias("tienda_id"),
                   F.col("banco_origen").alias("banco_id"), _neg(F.col("monto")).alias("m"))
    inn = F.struct(F.lit("Traspaso Entrada").alias("tipo"), F.col("tienda_destino").alias("tienda_id"),
                   F.col("banco_destino").alias("banco_id"), F.col("monto").cast(MONEY_SQL).alias("m"))
    ref = F.coalesce(F.nullif(F.col("referencia"), F.lit("")), F.lit(STORE_TRANSFER_DEFAULT_REF)) if "referencia" in cmds.columns \
        else F.lit(STORE_TRANSFER_DEFAULT_REF)
    e = v.select("id", "ts", ref.alias("_ref"), _user(cmds), (F.col("tienda_origen") != F.col("tienda_destino")).alias("_moves"),
                 F.explode(F.array(out, inn)).alias("x"))
    suffix = F.when(F.col("x.tipo") == "Traspaso Salida", F.lit(" (Salida)")).otherwise(F.lit(" (Entrada)"))
    tx = e.select(F.col("id").alias("comando_id"), F.col("ts").alias("fecha_hora"), F.col("x.tienda_id").alias("tienda_id"),
                  F.col("x.banco_id").alias("banco_id"), F.col("x.tipo").alias("tipo"),
                  F.col("x.m").alias("monto_efectivo"), _zero().alias("monto_banco"),
                  F.concat(F.col("_ref"), suffix).alias("referencia"), "usuario_id")
    p = e.filter("_moves").select(*posting("ts", "tienda", F.col("x.tienda_id"), None, F.col("x.m"), "delta",
                                           "traspaso", "id", 1))
    return {"transacciones": tx, "postings": p, "rejected": rejected}


def post_extra_income(cmds: DataFrame) -> dict[str, DataFrame]:
    """Extra income on a required bank: store cash +m. ``cmds``: id, ts,
    tienda_id, banco_id, monto [, referencia, usuario_id]."""
    valid, rejected = split_valid(cmds, "monto", required=["banco_id"])
    ref = F.coalesce(F.nullif(F.col("referencia"), F.lit("")), F.lit(EXTRA_INCOME_DEFAULT_REF)) if "referencia" in cmds.columns \
        else F.lit(EXTRA_INCOME_DEFAULT_REF)
    tx = valid.select(F.col("id").alias("comando_id"), F.col("ts").alias("fecha_hora"), "tienda_id", "banco_id",
                      F.lit("Ingreso Extra").alias("tipo"), F.col("monto").cast(MONEY_SQL).alias("monto_efectivo"),
                      _zero().alias("monto_banco"), ref.alias("referencia"), _user(cmds))
    p = valid.select(*posting("ts", "tienda", F.col("tienda_id"), None, F.col("monto"), "delta", "ingreso_extra", "id", 1))
    return {"transacciones": tx, "postings": p, "rejected": rejected}


def open_tills(forms: DataFrame) -> dict[str, DataFrame]:
    """I16: opening forms (id, ts, tienda_id, usuario_id, form map) -> opening
    rows and a ``set`` posting of the store cash. The cash is the form's
    ``monto_efectivo`` (commas removed); the bank map holds every
    ``banco_<id>`` field (commas removed, unparseable -> 0) as JSON."""
    e = forms.select("id", F.explode("form").alias("_k", "_v"))
    banks = e.filter(F.col("_k").startswith("banco_")).select(
        "id", F.regexp_replace("_k", "^banco_", "").alias("banco_key"),
        money_or_zero(F.col("_v"), "commas").alias("monto"))
    js = snapshot_json(banks, ["id"], "banco_key", "monto", "saldos_bancos_json")
    cash = parse_money(F.element_at(F.col("form"), F.lit("monto_efectivo")), "commas")
    ap = forms.join(js, "id", "left").select(
        "id", "tienda_id", "usuario_id", cash.alias("saldo_inicial_efectivo"),
        F.coalesce("saldos_bancos_json", F.lit("{}")).alias("saldos_bancos_json"),
        F.col("ts").alias("fecha_hora"), F.lit("Abierta").alias("estado"))
    p = ap.select(*posting("fecha_hora", "tienda", F.col("tienda_id"), None, F.col("saldo_inicial_efectivo"), "set",
                           "apertura", "id", 0))
    return {"aperturas": conform(ap, "aperturas_caja"), "postings": p}


def balance_before(postings: DataFrame, cmds: DataFrame, key: str, ts: str, cuenta: str = "tienda") -> DataFrame:
    """Account balance just before each command time (strictly earlier
    postings), for commands that assign a balance (closing, count
    adjustment, explicit set). The commands take part in the running balance
    as postings of nothing that come before all others of their time, so one
    scan gives the balance that each of them finds; no rows are paired."""
    from tillbook.operators.windows import running_balance
    own = F.struct(*[F.col(c) for c in cmds.columns])
    probes = cmds.select(F.col(key).alias("_acc"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("orden"),
                         F.xxhash64(*cmds.columns).alias("fuente_id"), _zero().alias("monto"), F.lit("delta").alias("tipo_asiento"),
                         own.alias("_cmd"))
    acc_key = "tienda_id" if cuenta == "tienda" else "banco_id"
    rows = postings.filter(F.col("cuenta") == cuenta).select(
        F.col(acc_key).alias("_acc"), "ts", F.col("orden").cast("long").alias("orden"), F.col("fuente_id").cast("long").alias("fuente_id"),
        "monto", "tipo_asiento", F.lit(None).cast(probes.schema["_cmd"].dataType).alias("_cmd"))
    run = running_balance(rows.unionByName(probes), ["_acc"], "ts", ["orden", "fuente_id"], "monto", "tipo_asiento")
    return run.filter(F.col("_cmd").isNotNull()).select(*[F.col("_cmd")[c].alias(c) for c in cmds.columns],
                                                        F.col("saldo").alias("saldo_antes"))


def post_count_adjustment(cmds: DataFrame, balances: DataFrame) -> dict[str, DataFrame]:
    """Counted treasury cash per bank (``cmds``: id, ts, banco_id,
    contado [, referencia]). diff = system - counted is logged as an 'Ajuste
    de Cuadre' outflow so that the balance equals the count; diff = 0 logs
    nothing. ``balances``: (banco_id, saldo) system balances before the batch;
    the reference uses the full-history flow (E17), not snapshot + flow. After
    a count the balance is the counted amount, so a later count of the same
    bank in the batch is compared with that."""
    b = balances.select(F.col("banco_id").alias("_b"), F.col("saldo").alias("_sys"))
    j = cmds.join(b, cmds.banco_id.eqNullSafe(b._b), "left")
    before = F.lag("contado").over(in_sequence("banco_id", "ts", "id"))
    j = j.withColumn("_sys", F.coalesce(before, F.col("_sys"), _zero()).cast(MONEY_SQL))
    diff = (F.col("_sys") - F.col("contado")).cast(MONEY_SQL)
    ref = F.coalesce(F.nullif(F.col("referencia"), F.lit("")), F.lit(COUNT_ADJ_DEFAULT_REF)) if "referencia" in cmds.columns \
        else F.lit(COUNT_ADJ_DEFAULT_REF)
    j = j.withColumn("diferencia", diff).withColumn("_ref", ref)
    log = j.filter(F.col("diferencia") != 0).select(
        F.col("id").alias("comando_id"), F.lit("Ajuste de Cuadre").alias("tipo"), F.col("diferencia").alias("monto"),
        F.col("_ref").alias("referencia"), F.col("ts").alias("fecha_hora"), "banco_id",
        F.lit(None).cast("long").alias("banco_destino_id"))
    return {"log": log, "ajustes": j.select("id", "banco_id", "contado", F.col("_sys").alias("sistema"),
                                            "diferencia")}


def reverse_transactions(tx: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Undo both legs of the named transactions and drop them; an id named
    more than once is undone once."""
    named = ids.select(F.col("id").alias("_rid")).distinct()
    hit = tx.join(named, tx.id == F.col("_rid"), "inner")
    legs = store_and_bank_legs(hit, "fecha_hora", _neg(F.col("monto_efectivo")), _neg(F.col("monto_banco")),
                               "reverso", "id", 3)
    kept = tx.join(named, tx.id == F.col("_rid"), "left_anti")
    return {"postings": legs, "transacciones": kept}


def repost_transactions(tx: DataFrame, edits: DataFrame, com: DataFrame) -> dict[str, DataFrame]:
    """Edit (id, monto, referencia, ts): reverse the old legs, apply the
    edit rule table to the new amount, restamp the time. Several edits of one
    row apply in their order: each reverses the legs that the one before left,
    and the row ends as the last edit leaves it. Negative and missing amounts
    are returned as ``rejected``. Both sides are dealt by id to all shuffle
    partitions: a task sorts its rows three times (for the join and for the
    order of edits), so partitions merged up to a size would cost it several
    times that in memory."""
    n = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = F.coalesce(F.col("monto") >= 0, F.lit(False))
    e = edits.filter(ok).select(
        F.col("id").alias("_eid"), F.col("monto").alias("_m"), F.col("referencia").alias("_ref"), F.col("ts").alias("_ts"))
    # commissions come first: a shuffle for their join would undo the deal
    t, e = with_commission(tx, com).repartition(n, "id"), e.repartition(n, "_eid")
    j = t.join(e, t.id == e._eid, "inner")
    cash, bank = signed_legs(F.col("tipo"), F.col("_m"), F.col("com_ef"), F.col("com_vi"), EDIT_RULES)
    j = j.withColumn("_new_ef", cash).withColumn("_new_vi", bank)
    seq = in_sequence("_eid", "_ts", "_m", "_ref")
    old_ef = F.coalesce(F.lag("_new_ef").over(seq), F.col("monto_efectivo"))
    old_vi = F.coalesce(F.lag("_new_vi").over(seq), F.col("monto_banco"))
    j = (j.withColumn("_old_ef", old_ef).withColumn("_old_vi", old_vi)
          .withColumn("_final", F.lead(F.lit(1)).over(seq).isNull()))
    d_ef = (F.col("_new_ef") - F.col("_old_ef")).cast(MONEY_SQL)
    d_vi = (F.col("_new_vi") - F.col("_old_vi")).cast(MONEY_SQL)
    p = store_and_bank_legs(j, "_ts", d_ef, d_vi, "edicion", "id", 3, zeros=True)
    new = j.filter("_final").select("id", F.col("_ts").alias("fecha_hora"), "tienda_id", "banco_id", "usuario_id", "tipo",
                   F.col("_new_ef").alias("monto_efectivo"), F.col("_new_vi").alias("monto_banco"),
                   F.col("com_ef").alias("comision_efectivo"), F.col("com_vi").alias("comision_banco"),
                   F.col("_ref").alias("referencia"))
    flagged = j.filter(F.col("_final") & ~F.col("tipo").isin(list(EDIT_RULES))).select("id", "tipo", F.lit("tipo_sin_regla").alias("motivo"))
    return {"postings": p, "transacciones": conform(new, "transacciones"), "flagged": flagged,
            "rejected": edits.filter(~ok)}


def adjust_expenses(gastos: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Edit (id, monto >= 0 [, descripcion, categoria]) or delete (monto
    NULL) of expenses: bank +old -new (a delete gives the old amount back).
    Several edits of one expense apply in their order, each against the amount
    the one before left; after a delete nothing more happens. Edits with a
    negative amount are rejected."""
    rejected = edits.filter(F.col("monto") < 0)
    e = edits.filter(F.col("monto").isNull() | (F.col("monto") >= 0))
    extra = [c for c in ("descripcion", "categoria") if c in edits.columns]
    e = e.select(F.col("id").alias("_eid"), F.col("monto").alias("_new"), F.col("ts").alias("_ts"),
                 *[F.col(c).alias(f"_n_{c}") for c in extra])
    seq = in_sequence("_eid", "_ts", "_new", *[f"_n_{c}" for c in extra])
    gone = F.sum(F.col("_new").isNull().cast("int")).over(seq.rowsBetween(W.unboundedPreceding, -1))
    e = (e.withColumn("_before", F.lag("_new").over(seq)).withColumn("_gone", F.coalesce(gone, F.lit(0)))
          .filter("_gone = 0"))
    j = gastos.join(e, gastos.id == e._eid, "inner")
    delta = (F.coalesce("_before", "monto") - F.coalesce(F.col("_new"), _zero())).cast(MONEY_SQL)
    p = j.select(*posting("_ts", "banco", None, F.col("banco_id"), delta, "delta", "gasto_ajuste", "id", 3))
    kept = gastos.join(e.filter(F.col("_new").isNull()), gastos.id == e._eid, "left_anti")
    last = one_per_target(e.drop("_before", "_gone"), "_eid", "_ts", "last")
    upd = kept.join(last, kept.id == last._eid, "left")
    cols = []
    for x in gastos.columns:
        if x == "monto":
            cols.append(F.coalesce(F.col("_new"), F.col("monto")).alias("monto"))
        elif x in extra:
            cols.append(F.when(F.col("_eid").isNotNull(), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x))
        else:
            cols.append(F.col(x))
    return {"postings": p, "gastos": upd.select(*cols), "rejected": rejected}


def reverse_debts(dep: DataFrame, cmds: DataFrame) -> dict[str, DataFrame]:
    """Drop advance deposits; with ``revertir`` the bank amount is taken
    back (bank -m). The first command on a debt drops it."""
    c = one_per_target(cmds.select("deposito_id", "ts", "revertir"), "deposito_id", "ts").select(F.col("deposito_id").alias("_did"), F.col("revertir").alias("_rev"), F.col("ts").alias("_ts"))
    j = dep.join(c, dep.id == c._did, "inner")
    p = j.filter("_rev").select(*posting("_ts", "banco", None, F.col("banco_id"), _neg(F.col("monto")), "delta",
                                         "reverso_deuda", "id", 3))
    kept = dep.join(c, dep.id == c._did, "left_anti")
    return {"postings": p, "depositos": kept}


def set_bank_balance(saldos: DataFrame, cmds: DataFrame) -> DataFrame:
    """New opening balance per bank; an explicit current balance is set
    absolutely, otherwise current += (new opening - old opening). ``cmds``:
    banco_id, saldo_inicial, saldo_actual [, ts]. Several commands on a bank
    apply in the order of ``ts``: the differences of the opening balances add
    up, so the result is the last explicit balance (or the stored one) plus
    the last opening balance minus the one that went with it. Where the table
    has its update time, that of the last command on the bank takes its place."""
    order = F.struct(*([F.col("ts")] if "ts" in cmds.columns else []), "saldo_inicial", "saldo_actual")
    explicit = F.when(F.col("saldo_actual").isNotNull(), order)
    c = cmds.groupBy(F.col("banco_id").alias("_b")).agg(
        F.max(order).alias("_last"), F.max(explicit).alias("_set"))
    j = saldos.join(c, saldos.banco_id == c._b, "left")
    hit = F.col("_b").isNotNull()
    start = F.when(F.col("_set").isNotNull(), F.col("_set.saldo_actual")).otherwise(F.col("saldo"))
    old = F.when(F.col("_set").isNotNull(), F.col("_set.saldo_inicial")).otherwise(F.col("saldo_inicial"))
    moved = F.coalesce("_last.saldo_inicial", _zero()) - F.coalesce(old, _zero())
    return j.select("banco_id", F.when(hit, start + moved).otherwise(F.col("saldo")).cast(MONEY_SQL).alias("saldo"),
                    F.when(hit, F.col("_last.saldo_inicial")).otherwise(F.col("saldo_inicial")).cast(MONEY_SQL)
                    .alias("saldo_inicial"),
                    *([F.when(hit, F.col("_last.ts").cast("timestamp_ntz")).otherwise(F.col("actualizado_en")).alias("actualizado_en")]
                      if "ts" in cmds.columns and "actualizado_en" in saldos.columns else []))


def bank_balance_postings(saldos: DataFrame, cmds: DataFrame) -> DataFrame:
    """A ``set`` posting per bank named by ``cmds`` (with ``ts``): its
    balance after them, at the time of the last one."""
    after = set_bank_balance(saldos.select("banco_id", "saldo", "saldo_inicial", F.lit(None).cast("timestamp_ntz").alias("actualizado_en")), cmds)
    return after.filter(F.col("actualizado_en").isNotNull()).select(
        *posting("actualizado_en", "banco", None, F.col("banco_id"), F.col("saldo"), "set", "saldo", "banco_id", 0))


def upsert_commissions(com: DataFrame, changes: DataFrame, epoch: str = "1970-01-01 00:00:00") -> DataFrame:
    """Commission history as SCD2: every rule version gets
    [valid_from, valid_to) by ``lead`` over (bank, type) ordered by time."""
    cur = com.select("banco_id", "tipo_transaccion", "valor_efectivo", "valor_virtual",
                     F.lit(epoch).cast("timestamp_ntz").alias("valido_desde"), F.col("id").alias("version"))
    ch = changes.select("banco_id", "tipo_transaccion", "valor_efectivo", "valor_virtual",
                        F.col("ts").alias("valido_desde"), F.col("id").alias("version"))
    allv = cur.unionByName(ch)
    w = W.partitionBy("banco_id", "tipo_transaccion").orderBy("valido_desde", "version")
    return allv.withColumn("valido_hasta", F.lead("valido_desde").over(w))


def merge_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """insert/update/delete users by username (no passwords): the store
    is kept only for cashiers; 'admin' cannot be deleted. Of several changes to
    one name the last one (by ``ts`` if given, else id) stands."""
    ch = one_per_target(changes, "username", "ts" if "ts" in changes.columns else "id", "last").select(F.col("username").alias("_un"), F.col("rol").alias("_rol"), F.col("tienda_id").alias("_t"),
                        F.col("accion").alias("_acc"), F.col("id").alias("_nid"))
    j = users.join(ch, users.username == ch._un, "full_outer")
    delete = (F.col("_acc") == "eliminar") & (F.coalesce(F.col("username"), F.col("_un")) != "admin")
    rol = F.coalesce(F.col("_rol"), F.col("rol"))
    out = j.filter(~delete | F.col("_acc").isNull()).select(
        F.coalesce(F.col("id"), F.col("_nid")).alias("id"), F.coalesce(F.col("username"), F.col("_un")).alias("username"),
        rol.alias("rol"),
        F.when(rol == "Cajero", F.when(F.col("_acc").isNotNull(), F.col("_t")).otherwise(F.col("tienda_id")))
         .cast("long").alias("tienda_id"))
    return out.filter(F.col("username").isNotNull())


def edit_users(users: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """I28 by id (``changes``: id, username, rol, tienda_id, accion [, ts]):
    'editar' gives the user of that id another name, role and store, 'eliminar'
    drops that user (never 'admin'), 'insertar' adds one. The store is kept only
    for cashiers. Of several changes to one id the last one (by ``ts`` if given)
    stands. Names stay unique: a change to a name that another user has, or
    that a change of a smaller id takes, is refused ('nombre_existente'), as is
    adding an id that exists ('id_existente') and editing one that does not
    ('sin_usuario'). Returns ``usuarios`` and ``rejected``."""
    ch = one_per_target(changes, "id", "ts" if "ts" in changes.columns else None, "last")
    ch = ch.select(F.col("id").alias("_cid"), F.col("username").alias("_cname"), F.col("rol").alias("_crol"), F.col("tienda_id").alias("_ct"),
                   F.col("accion").alias("_acc"))
    have = users.select(F.col("id").alias("_uid"), F.col("username").alias("_uname"))
    ch = ch.join(have, ch["_cid"] == have["_uid"], "left")
    holder = users.groupBy(F.col("username").alias("_hname")).agg(F.min("id").alias("_holder"))
    ch = ch.join(holder, ch["_cname"] == holder["_hname"], "left")
    names = F.col("_acc").isin("editar", "insertar")
    wanted = ch.filter(names).groupBy(F.col("_cname").alias("_wname")).agg(F.min("_cid").alias("_taker"))
    ch = ch.join(wanted, ch["_cname"] == wanted["_wname"], "left")
    taken = names & ((F.col("_holder").isNotNull() & (F.col("_holder") != F.col("_cid"))) | (F.col("_taker") != F.col("_cid")))
    why = (F.when((F.col("_acc") == "insertar") & F.col("_uid").isNotNull(), "id_existente")
           .when((F.col("_acc") != "insertar") & F.col("_uid").isNull(), "sin_usuario").when(taken, "nombre_existente")
           .when((F.col("_acc") == "eliminar") & (F.col("_uname") == "admin"), "admin"))
    ch = ch.withColumn("motivo", why)
    good = ch.filter("motivo is null").select("_cid", "_cname", "_crol", "_ct", "_acc")
    store = F.when(F.col("_crol") == "Cajero", F.col("_ct")).cast("long")
    j = users.join(good, users["id"] == good["_cid"], "full_outer").filter(F.coalesce(F.col("_acc") != "eliminar", F.lit(True)))
    hit = F.col("_acc").isNotNull()
    out = j.select(F.coalesce("id", "_cid").alias("id"), F.when(hit, F.col("_cname")).otherwise(F.col("username")).alias("username"),
                   F.when(hit, F.col("_crol")).otherwise(F.col("rol")).alias("rol"), F.when(hit, store).otherwise(F.col("tienda_id")).alias("tienda_id"))
    rejected = ch.filter("motivo is not null").select(F.col("_cid").alias("id"), F.col("_cname").alias("username"), F.col("_acc").alias("accion"), "motivo")
    return {"usuarios": out, "rejected": rejected}


def close_tills(forms: DataFrame, postings: DataFrame, openings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Closing forms as a bulk job. The theoretical balance of each form
    is the store cash just before it (postings fold, strictly earlier), then
    H8 gives the closing row, adjustment and remittances; the new store cash
    is a ``set`` posting of the carry-over. With ``openings`` (the opening
    table) ``aperturas`` is that table with the closed tills: every open
    opening of the form's user (of its store, where forms name no user) at or
    before the last form is 'Cerrada'."""
    from tillbook.plans.closings import close_shift
    exp = balance_before(postings, forms.select("form_id", "tienda_id", "ts"), "tienda_id", "ts")
    out = close_shift(forms, exp.select("form_id", F.col("saldo_antes").alias("saldo_teorico")))
    out["postings"] = out["closings"].select(*posting("fecha", "tienda", F.col("tienda_id"), None,
                                                      F.col("saldo_final"), "set", "cierre", "form_id", 2))
    if openings is not None:
        owner = "usuario_id" if "usuario_id" in forms.columns else "tienda_id"
        last = forms.groupBy(F.col(owner).alias("_st")).agg(F.max("ts").alias("_closed"))
        closed = (F.col("estado") == "Abierta") & F.coalesce(F.col("fecha_hora") <= F.col("_closed"), F.lit(False))
        out["aperturas"] = openings.join(last, openings[owner] == last._st, "left").select(
            *[F.when(closed, F.lit("Cerrada")).otherwise(F.col(x)).alias(x) if x == "estado" else F.col(x)
              for x in openings.columns])
    return out
