"""Several commands on one row in one batch, and matches of equal amounts."""

import datetime as dt
from decimal import Decimal as D

from tillbook.operators import posting as I
from tillbook.operators import reversals as R
from tillbook.operators.joins import match_tolerance
from tillbook.sources.schemas import LEDGER_SCHEMAS

T0 = dt.datetime(2024, 1, 1, 8, 0)
H = dt.timedelta(hours=1)
RULES = "id long, tipo_transaccion string, banco_id long, valor_efectivo decimal(18,2), valor_virtual decimal(18,2)"


def table(spark, name, rows):
    """Rows as dicts; columns not named are null."""
    schema = LEDGER_SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def total(df, cuenta):
    return sum(r.monto for r in df.collect() if r.cuenta == cuenta)


def tx_row(**kw):
    return {"id": 1, "fecha_hora": T0, "tienda_id": 1, "tipo": "Retiro", "monto_efectivo": D("-10"),
            "monto_banco": D("0"), **kw}


def test_edits_of_one_transaction_chain(spark):
    tx = table(spark, "transacciones", [tx_row()])
    edits = spark.createDataFrame([(1, D("20"), "a", T0 + H), (1, D("30"), "b", T0 + 2 * H), (1, D("-1"), "c", T0 + 3 * H)],
                                  "id long, monto decimal(18,2), referencia string, ts timestamp_ntz")
    out = I.repost_transactions(tx, edits, spark.createDataFrame([], RULES))
    assert total(out["postings"], "tienda") == D("-20")
    assert [(r.monto_efectivo, r.referencia) for r in out["transacciones"].collect()] == [(D("-30"), "b")]
    assert [r.referencia for r in out["rejected"].collect()] == ["c"]


def test_edits_are_dealt_to_all_partitions_once(spark):
    """Both legs come from one pass over the edits, dealt by id to all shuffle
    partitions (none merged); a bank leg of zero is a leg, no bank is none."""
    tx = table(spark, "transacciones", [tx_row(id=i, banco_id=None if i % 4 == 0 else 2, monto_banco=D(i)) for i in range(80)])
    edits = spark.createDataFrame([(i, D(i), "a", T0 + H) for i in range(80)],
                                  "id long, monto decimal(18,2), referencia string, ts timestamp_ntz")
    p = I.repost_transactions(tx, edits, spark.createDataFrame([], RULES))["postings"]
    parts = p.rdd.glom().collect()
    assert len(parts) == 8 and all(parts)
    rows = [r for part in parts for r in part]
    assert sorted(r.fuente_id for r in rows if r.cuenta == "tienda") == list(range(80))
    assert sorted((r.fuente_id, r.monto) for r in rows if r.cuenta == "banco") == [(i, D(0)) for i in range(80) if i % 4]


def test_repeats_act_once(spark):
    rem = table(spark, "remesas", [{"id": 1, "tienda_id": 1, "monto": D("5"), "fecha_envio": T0, "estado": "Pendiente"}])
    cmds = spark.createDataFrame([(1, T0 + H, 7), (1, T0 + 2 * H, 8)], "remesa_id long, fecha timestamp_ntz, usuario_id long")
    got = I.receive_remits(rem, cmds).collect()
    assert [(r.fecha_recepcion, r.usuario_recibe_id) for r in got] == [(T0 + 2 * H, 8)]
    dep = table(spark, "depositos_adelantados", [{"id": 3, "banco_id": 1, "monto": D("50"), "referencia": "", "fecha_hora": T0,
                                                  "estado": "Pendiente"}])
    pay = spark.createDataFrame([(3, T0 + 2 * H), (3, T0 + H)], "deposito_id long, ts timestamp_ntz")
    out = I.pay_advances(dep, pay)
    assert [(r.fecha_hora, r.referencia) for r in out["log"].collect()] == [(T0 + H, "Pago de Depósito Pendiente")]
    assert [r.fecha_pago for r in out["depositos"].collect()] == [T0 + H]
    undo = spark.createDataFrame([(3, True, T0), (3, True, T0 + H)], "deposito_id long, revertir boolean, ts timestamp_ntz")
    assert total(I.reverse_debts(dep, undo)["postings"], "banco") == D("-50")
    tx = table(spark, "transacciones", [tx_row(banco_id=2, monto_banco=D("10"))])
    legs = I.reverse_transactions(tx, spark.createDataFrame([(1,), (1,)], "id long"))["postings"]
    assert legs.count() == 2
    back = spark.createDataFrame([(1, True, T0), (1, True, T0 + H)], "remesa_id long, revertir boolean, ts timestamp_ntz")
    assert total(R.reverse_remits(rem, back, tx)["postings"], "tienda") == D("5")


def test_expense_edits_then_delete(spark):
    g = table(spark, "gastos", [{"id": 1, "banco_id": 1, "monto": D("100"), "fecha_hora": T0},
                                {"id": 2, "banco_id": 1, "monto": D("40"), "fecha_hora": T0}])
    edits = spark.createDataFrame([(1, D("80"), T0), (1, D("70"), T0 + H), (2, D("50"), T0), (2, None, T0 + H),
                                   (2, D("9"), T0 + 2 * H)], "id long, monto decimal(18,2), ts timestamp_ntz")
    out = I.adjust_expenses(g, edits)
    per = {}
    for r in out["postings"].collect():
        per[r.fuente_id] = per.get(r.fuente_id, 0) + r.monto
    assert per == {1: D("30"), 2: D("40")}
    assert [(r.id, r.monto) for r in out["gastos"].collect()] == [(1, D("70"))]


def test_counts_and_balances_in_order(spark):
    cmds = spark.createDataFrame([(1, T0, 1, D("90")), (2, T0 + H, 1, D("95"))],
                                 "id long, ts timestamp_ntz, banco_id long, contado decimal(18,2)")
    bal = spark.createDataFrame([(1, D("100"))], "banco_id long, saldo decimal(18,2)")
    log = {r.comando_id: r.monto for r in I.post_count_adjustment(cmds, bal)["log"].collect()}
    assert log == {1: D("10"), 2: D("-5")}
    saldos = spark.createDataFrame([(1, D("100"), D("10")), (2, D("100"), D("10"))],
                                   "banco_id long, saldo decimal(18,2), saldo_inicial decimal(18,2)")
    sets = spark.createDataFrame([(1, D("20"), None, T0), (1, D("5"), None, T0 + H), (2, D("20"), D("500"), T0),
                                  (2, D("25"), None, T0 + H)],
                                 "banco_id long, saldo_inicial decimal(18,2), saldo_actual decimal(18,2), ts timestamp_ntz")
    got = sorted(tuple(r) for r in I.set_bank_balance(saldos, sets).collect())
    assert got == [(1, D("95"), D("5")), (2, D("505"), D("25"))]


def test_sends_pair_one_to_one(spark):
    log = table(spark, "tesoreria_log", [
        {"id": i, "tipo": "Envío a Tienda", "monto": D(m), "fecha_hora": T0} for i, m in ((1, "100.00"), (2, "100.05"), (3, "100.05"))])
    tx = table(spark, "transacciones", [
        tx_row(id=i, tienda_id=s, tipo="Resurtido Tesorería", monto_efectivo=D(m))
        for i, s, m in ((11, 3, "100.00"), (12, 4, "100.05"), (13, 5, "100.08"), (14, 6, "300"))])
    ids = spark.createDataFrame([(1, T0), (2, T0), (3, T0), (3, T0)], "id long, ts timestamp_ntz")
    out = R.reverse_treasury_log(log, ids, tx)
    assert sorted(tuple(r) for r in out["matched"].collect()) == [(1, 11), (2, 12), (3, 13)]
    assert sorted((r.tienda_id, r.monto) for r in out["postings"].collect()) == [
        (3, D("-100.00")), (4, D("-100.05")), (5, D("-100.05"))]
    assert [r.id for r in out["transacciones"].collect()] == [14]
    assert sorted(tuple(r) for r in out["ambiguos"].collect()) == [(1, 3), (2, 3), (3, 3)]


def test_sends_meet_restocks_across_step_edges(spark):
    amounts = {1: "100.09", 2: "200.05", 3: "300.09", 4: "400.00", 5: "500.01"}
    log = table(spark, "tesoreria_log", [{"id": i, "tipo": "Envío a Tienda", "monto": D(m), "fecha_hora": T0} for i, m in amounts.items()])
    ids = spark.createDataFrame([(i, T0) for i in amounts], "id long, ts timestamp_ntz")
    other = {11: "100.11", 12: "200.14", 13: "300.00", 14: "400.10", 15: "499.93"}
    tx = table(spark, "transacciones", [{"id": i, "tipo": "Resurtido Tesorería", "monto_efectivo": D(m), "fecha_hora": T0,
                                         "tienda_id": 1} for i, m in other.items()])
    out = R.reverse_treasury_log(log, ids, tx)
    assert sorted(tuple(r) for r in out["matched"].collect()) == [(1, 11), (2, 12), (3, 13), (5, 15)]
    assert [r.id for r in out["transacciones"].collect()] == [14]
    assert sorted(r.monto for r in out["postings"].collect()) == [D("-500.01"), D("-300.09"), D("-200.05"), D("-100.09")]


def test_many_equal_amounts_stay_linear(spark):
    a = spark.range(2000).selectExpr("id", "cast(5 as decimal(18,2)) monto", "timestamp_ntz'2024-01-01 08:10:00' ts")
    b = a.selectExpr("id + 7 as id", "monto", "ts")
    got = match_tolerance(a, b, "monto", "monto", "ts", "ts", 0.1, first=True)
    assert got.count() == 2000 and got.select("m_id").distinct().collect()[0][0] == 7


def test_two_closings_reopen_two_openings(spark):
    ci = table(spark, "cierres_caja", [{"id": i, "tienda_id": 1, "fecha": T0, "saldo_teorico": D("1")} for i in (1, 2)])
    ap = table(spark, "aperturas_caja", [{"id": i, "tienda_id": 1, "fecha_hora": T0, "estado": "Cerrada"} for i in (1, 2, 3)])
    cmds = spark.createDataFrame([(1, T0), (2, T0), (2, T0 + H)], "cierre_id long, ts timestamp_ntz")
    out = R.reverse_closings(ci, ap, table(spark, "remesas", []), cmds)
    assert sorted(r.apertura_id for r in out["reabrir"].collect()) == [2, 3]
    assert {r.id: r.estado for r in out["aperturas"].collect()} == {1: "Cerrada", 2: "Abierta", 3: "Abierta"}


def test_resets_zero_and_empty(spark):
    from tillbook.operators.validation import latest_state_reset
    L = {n: table(spark, n, []) for n in LEDGER_SCHEMAS}
    L["saldos_bancarios"] = table(spark, "saldos_bancarios", [{"banco_id": 1, "saldo": D("5"), "saldo_inicial": D("6")}])
    L["tesoreria_log"] = table(spark, "tesoreria_log", [{"id": 1}])
    L["gastos"] = table(spark, "gastos", [{"id": 1}])
    op = latest_state_reset(L, "operational")
    assert op["tesoreria_log"].count() == op["gastos"].count() == 0
    assert [(r.saldo, r.saldo_inicial) for r in op["saldos_bancarios"].collect()] == [(D("0"), D("0"))]
    tr = latest_state_reset(L, "treasury")
    assert [(r.saldo, r.saldo_inicial) for r in tr["saldos_bancarios"].collect()] == [(D("0"), D("6"))]
    assert tr["gastos"].count() == 1


def test_totals_wider_than_one_amount(spark):
    from tillbook.operators.aggregations import outstanding_debt_total, pending_remits_by_bank
    big = D("9999999999999999.99")
    rem = table(spark, "remesas", [{"id": i, "monto": big, "estado": "Pendiente"} for i in range(5)])
    assert pending_remits_by_bank(rem).collect()[0].total_remesa == 5 * big
    dep = table(spark, "depositos_adelantados", [{"id": i, "monto": big, "estado": "Pendiente"} for i in range(5)])
    assert outstanding_debt_total(dep).collect()[0].deuda_total == 5 * big
