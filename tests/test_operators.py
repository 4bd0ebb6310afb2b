"""Hand-made cases per rule, and invariants against brute force."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillbook.functions.balances import explode_balances, js_number_text, snapshot_json
from tillbook.functions.breakdown import breakdown_long, build_breakdown, parse_breakdown
from tillbook.functions.money import parse_money, round_cents
from tillbook.operators import joins as J
from tillbook.operators import posting as I
from tillbook.operators.aggregations import treasury_flow
from tillbook.operators.windows import running_balance

T0 = dt.datetime(2024, 1, 1, 8, 0)


def test_parse_money_modes(spark):
    df = spark.createDataFrame([("1,250.00",), ("L 1,234.50",), ("- L 8",), ("12abc",), ("",), (None,)], "t string")
    rows = df.select(parse_money("t", "commas").alias("c"), parse_money("t", "strict").alias("s"),
                     parse_money("t", "raw").alias("r")).collect()
    assert [r.c for r in rows] == [D("1250.00"), None, None, D("12.00"), None, None]
    assert [r.s for r in rows] == [D("1250.00"), D("1234.50"), D("-8.00"), D("12.00"), None, None]
    assert [r.r for r in rows] == [D("1.00"), None, None, D("12.00"), None, None]


def test_round_cents_ties_up(spark):
    df = spark.createDataFrame([(D("-0.005"),), (D("0.005"),), (D("1.005"),), (D("-1.235"),)], "x decimal(10,3)")
    got = [r[0] for r in df.select(round_cents("x")).collect()]
    assert got == [D("0.00"), D("0.01"), D("1.01"), D("-1.23")]


def test_explode_balances_cases(spark):
    df = spark.createDataFrame([(1, '{"1": 100, "2": "50.5", "Otros": 7}'), (2, "garbage"), (3, None),
                                (4, '{"9": "abc"}')], "id long, j string")
    rows = sorted((r.id, r.bal_key, r.bal_amount) for r in explode_balances(df, "j").collect())
    assert rows == [(1, "1", D("100.00")), (1, "2", D("50.50")), (1, "Otros", D("7.00")), (4, "9", None)]


def test_breakdown_parse_and_negative_dropped(spark):
    df = spark.createDataFrame([(1, "0: L 100.00 | 1: L -5.00 | Otros: L 1,000.25 || ENTREGA: 0: L 10.00 / Otros: L 5.00"),
                                (2, "3: L 7.00"), (3, None)], "id long, t string")
    p = {r.id: r for r in parse_breakdown(df, "t").collect()}
    assert p[1].declarado == {"0": D("100.00"), "Otros": D("1000.25")}
    assert p[1].entregado == {"0": D("10.00"), "Otros": D("5.00")} and p[1].total_entregado == D("15.00")
    assert p[2].declarado == {"3": D("7.00")} and p[2].entregado == {} and p[2].total_entregado == D("0.00")
    assert p[3].declarado == {}


def test_breakdown_round_trip(spark):
    text = "0: L 100.00 | 1: L 200.50 | Otros: L 3.00 || ENTREGA: 1: L 20.00 / Otros: L 1.00"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    long = breakdown_long(df, ["id"], "t")
    per_key = long.groupBy("id", "clave").agg(
        F.sum(F.when(F.col("parte") == "declarado", F.col("monto"))).alias("declarado"),
        F.sum(F.when(F.col("parte") == "entregado", F.col("monto"))).alias("entregado"))
    assert build_breakdown(per_key, ["id"]).collect()[0].desglose_bancos == text


def test_snapshot_json_js_order(spark):
    df = spark.createDataFrame([("Otros", D("60.00")), ("10", D("1.50")), ("2", D("300.00")), ("0", D("-2.25"))],
                               "k string, v decimal(18,2)")
    assert snapshot_json(df, [], "k", "v").collect()[0].saldos_json == '{"0":-2.25,"2":300,"10":1.5,"Otros":60}'
    assert spark.range(1).select(js_number_text(F.lit(D("100.10")))).collect()[0][0] == "100.1"


def _tx(spark, rows):
    return spark.createDataFrame(rows, "id long, tienda_id long, fecha_hora timestamp_ntz, monto_efectivo decimal(18,2)")


def test_interval_join_edges_and_overlap(spark):
    h = dt.timedelta(hours=1)
    tx = _tx(spark, [(1, 1, T0, D("1")), (2, 1, T0 + 10 * h, D("2")), (3, 1, T0 + 12 * h, D("4")),
                     (4, 1, T0 - h, D("8")), (5, 2, T0 + h, D("16"))])
    shifts = spark.createDataFrame([(10, 1, T0, T0 + 10 * h), (11, 1, T0 + 5 * h, T0 + 12 * h),
                                    (12, 1, dt.datetime(2000, 1, 1), T0 - 2 * h)],
                                   "cierre_id long, tienda_id long, desde timestamp_ntz, hasta timestamp_ntz")
    got = sorted((r.cierre_id, r.id) for r in J.tx_in_shift(tx, shifts).collect())
    assert got == [(10, 1), (10, 2), (11, 2), (11, 3)]


def test_asof_against_brute_force(spark):
    rnd = random.Random(7)
    ap_rows, ci_rows = [], []
    for i in range(300):
        ap_rows.append((i, rnd.randint(0, 3), T0 + dt.timedelta(hours=rnd.randint(0, 24 * 5)), D(rnd.randint(0, 99))))
    for i in range(200):
        ci_rows.append((1000 + i, rnd.randint(0, 4), T0 + dt.timedelta(hours=rnd.randint(-5, 24 * 6))))
    ap = spark.createDataFrame(ap_rows, "id long, tienda_id long, fecha_hora timestamp_ntz, saldo_inicial_efectivo decimal(18,2)")
    ap = ap.withColumn("saldos_bancos_json", F.lit("{}"))
    ci = spark.createDataFrame(ci_rows, "id long, tienda_id long, fecha timestamp_ntz")
    j = J.asof_latest(ci, ap, "tienda_id", "fecha", "fecha_hora", ["saldo_inicial_efectivo"], "ap_")
    got = {r.id: r.ap_id for r in j.collect()}
    for cid, t, ts in ci_rows:
        cands = [(a_ts, a_id) for a_id, a_t, a_ts, _ in ap_rows if a_t == t and a_ts <= ts]
        want = max(cands)[1] if cands else None
        assert got[cid] == want, cid


def test_running_balance_against_fold(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        acct = rnd.randint(0, 2)
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 6))
        kind = "set" if rnd.random() < 0.1 else "delta"
        rows.append((acct, ts, i, D(rnd.randint(-500, 500)) / 100 if kind == "delta" else D(rnd.randint(0, 9999)) / 100, kind))
    df = spark.createDataFrame(rows, "acct long, ts timestamp_ntz, seq long, amount decimal(18,2), kind string")
    got = {r.seq: r.saldo for r in running_balance(df, ["acct"], "ts", ["seq"], "amount", "kind").collect()}
    bal = {}
    for acct, ts, seq, amount, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        bal[acct] = amount if kind == "set" else bal.get(acct, D(0)) + amount
        assert got[seq] == bal[acct], seq


def test_snapshot_cut_is_strict(spark):
    cut = dt.datetime(2000, 1, 1)
    rem = spark.createDataFrame([(1, D("5"), "Recibido", cut), (1, D("7"), "Recibido", cut + dt.timedelta(seconds=1))],
                                "banco_id long, monto decimal(18,2), estado string, fecha_recepcion timestamp_ntz")
    log = spark.createDataFrame([], "tipo string, monto decimal(18,2), fecha_hora timestamp_ntz, banco_id long")
    banks = spark.createDataFrame([(1,)], "id long")
    got = {r.banco_id: r.flujo for r in treasury_flow(rem, log, banks, cut).collect()}
    assert got == {1: D("7.00"), None: D("0.00")}


def test_post_then_reverse_is_identity(spark):
    cmds = spark.createDataFrame(
        [(1, T0, 1, 0, 9, "Depósito", D("100"), "r"), (2, T0, 1, 0, 9, "Retiro", D("50"), "r"),
         (3, T0, 2, None, 9, "Efectivo Entregado", D("20"), "r"), (4, T0, 2, 1, 9, "Depósito Cuenta", D("30"), "r")],
        "id long, fecha_hora timestamp_ntz, tienda_id long, banco_id long, usuario_id long, tipo string, "
        "monto decimal(18,2), referencia string")
    com = spark.createDataFrame([(1, "Retiro", 0, D("0"), D("10"))],
                                "id long, tipo_transaccion string, banco_id long, valor_efectivo decimal(18,2), "
                                "valor_virtual decimal(18,2)")
    posted = I.post_transactions(cmds, com)
    rev = I.reverse_transactions(posted["transacciones"], cmds.select("id"))
    legs = posted["postings"].unionByName(rev["postings"])
    sums = legs.groupBy("cuenta", "tienda_id", "banco_id").agg(F.sum("monto").alias("s")).collect()
    assert sums and all(r.s == 0 for r in sums)
    assert rev["transacciones"].count() == 0
    assert posted["remesas"].count() == 1


def test_parse_money_exponent(spark):
    df = spark.createDataFrame([("1.5e2abc",), ("2E-1",), ("3e",)], "t string")
    got = [r[0] for r in df.select(parse_money("t", "raw")).collect()]
    assert got == [D("150.00"), D("0.20"), D("3.00")]


def test_breakdown_repeated_key_last_wins(spark):
    df = spark.createDataFrame([(1, "0: L 1.00 | 0: L 2.00 || ENTREGA: Otros: L 1.00 / Otros: L 3.00")], "id long, t string")
    r = parse_breakdown(df, "t").collect()[0]
    assert r.declarado == {"0": D("2.00")} and r.entregado == {"Otros": D("3.00")} and r.total_entregado == D("3.00")
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"


def _with(L, **tables):
    out = dict(L.tables())
    out.update(tables)
    return out


def test_treasury_balance_independent_of_snapshot(spark, ledger):
    from tillbook.plans.treasury import close_treasury, treasury_balances
    from tillbook.sources.schemas import conform
    before = {r.banco_key: r.saldo for r in treasury_balances(ledger).collect()}
    snap = close_treasury(ledger, "2000-06-01 00:00:00").withColumn("id", F.lit(3).cast("long"))
    L2 = _with(ledger, cierres_tesoreria=ledger["cierres_tesoreria"].unionByName(conform(snap, "cierres_tesoreria")))
    after = {r.banco_key: r.saldo for r in treasury_balances(L2).collect()}
    assert before == after


def test_count_adjustment_sets_balance_to_count(spark, ledger):
    from tillbook.sources.schemas import conform
    full = lambda L: treasury_flow(L["remesas"], L["tesoreria_log"], L["bancos"], None)
    bal = full(ledger).select("banco_id", F.col("flujo").alias("saldo"))
    cmds = bal.select(F.coalesce("banco_id", F.lit(-1)).alias("id"), "banco_id",
                      (F.floor(F.col("saldo") / 100) * 100).cast("decimal(18,2)").alias("contado"),
                      F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    log = I.post_count_adjustment(cmds, bal)["log"].withColumnRenamed("comando_id", "id")
    L2 = _with(ledger, tesoreria_log=ledger["tesoreria_log"].unionByName(conform(log, "tesoreria_log")))
    counted = {r.banco_id: r.contado for r in cmds.collect()}
    after = {r.banco_id: r.flujo for r in full(L2).collect()}
    assert after == counted


def test_load_ledger_roundtrip_audit_matrix(spark):
    """A user's path: ledger tables stored as parquet folders -> load_ledger
    -> operators; equals the registered flagship query."""
    from tillbook.plans.audit import audit_matrix
    from tillbook.sources.io import load_ledger
    from tillbook.sources.store import build_ledger
    import __spark_entry__ as E
    from tests.conftest import SF_DIR
    path = build_ledger(spark, SF_DIR)
    L = load_ledger(spark, path)
    got = sorted(tuple(r) for r in audit_matrix(L).collect())
    want = sorted(tuple(r) for r in E.queries()["h1_audit_matrix"](spark, SF_DIR).collect())
    assert got == want and len(got) > 0


def test_running_balance_hot_account(spark):
    """One account holds ~70% of the rows, most of them on one day."""
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        acct = 0 if rnd.random() < 0.7 else rnd.randint(1, 3)
        hot_day = acct == 0 and rnd.random() < 0.8
        minutes = rnd.randint(0, 60 * 24 - 1) if hot_day else rnd.randint(0, 60 * 24 * 9)
        kind = "set" if rnd.random() < 0.05 else "delta"
        amount = D(rnd.randint(-900, 900)) / 100 if kind == "delta" else D(rnd.randint(0, 99999)) / 100
        rows.append((acct, T0 + dt.timedelta(minutes=minutes), i, amount, kind))
    df = spark.createDataFrame(rows, "acct long, ts timestamp_ntz, seq long, amount decimal(18,2), kind string")
    got = {r.seq: r.saldo for r in running_balance(df, ["acct"], "ts", ["seq"], "amount", "kind").collect()}
    bal = {}
    for acct, ts, seq, amount, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        bal[acct] = amount if kind == "set" else bal.get(acct, D(0)) + amount
        assert got[seq] == bal[acct], seq


def test_snapshot_json_round_trip_random(spark):
    from tillbook.functions.balances import balance_map
    rnd = random.Random(5)
    rows, want = [], {}
    for g in range(200):
        keys = rnd.sample(["0", "1", "2", "3", "10", "Otros"], rnd.randint(1, 6))
        want[g] = {}
        for k in keys:
            v = D(rnd.randint(-10 ** 7, 10 ** 7)) / 100
            rows.append((g, k, v))
            want[g][k] = v
    df = spark.createDataFrame(rows, "g long, k string, v decimal(18,2)")
    js = snapshot_json(df, ["g"], "k", "v")
    back = js.select("g", F.map_entries(balance_map("saldos_json")).alias("e")).collect()
    got = {r.g: {e.key: D(e.value) for e in r.e} for r in back}
    assert got == want


def test_normalize_ts_random_against_python(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for i in range(300):
        local = T0 + dt.timedelta(seconds=rnd.randint(0, 10 ** 8))
        text = local.strftime("%Y-%m-%d %H:%M:%S")
        if rnd.random() < 0.6:
            off = rnd.choice([-6, -5, 0, 2, 5])
            text += ("-" if off < 0 else "+") + f"{abs(off):02d}:00"
            want[i] = local - dt.timedelta(hours=off)
        else:
            want[i] = local
        rows.append((i, text))
    df = spark.createDataFrame(rows, "i long, t string")
    from tillbook.functions.timeparse import normalize_ts
    got = {r.i: r.u for r in df.select("i", normalize_ts("t").alias("u")).collect()}
    assert got == want


def _py_breakdown(text):
    """The breakdown grammar rules, stated directly."""
    import re
    pat = re.compile(r"^(.+?):\s*L\s*([\d.,]+)$")

    def entries(part, sep):
        out = {}
        for piece in part.split(sep):
            m = pat.match(piece.strip())
            if m:
                try:
                    out[m.group(1).strip()] = D(m.group(2).replace(",", "")).quantize(D("0.01"))
                except Exception:  # noqa: BLE001 - unparseable number reads as 0
                    out[m.group(1).strip()] = D("0.00")
        return out
    parts = (text or "").split("||")
    dec = entries(parts[0], "|")
    second = parts[1] if len(parts) > 1 else ""
    dlv = entries(second.replace("ENTREGA:", ""), "/") if "ENTREGA:" in second else {}
    return dec, dlv


def test_parse_breakdown_random_against_rules(spark):
    rnd = random.Random(13)
    keys = ["0", "1", "2", "Otros", "Banco X"]

    def entry():
        k = rnd.choice(keys)
        v = rnd.randint(-500, 2_000_000)
        amount = f"{v / 100:,.2f}" if rnd.random() < 0.5 else f"{v / 100:.2f}"
        return rnd.choice([f"{k}: L {amount}", f"{k}:L{amount}", f" {k} : L  {amount} ", "junk", f"{k}: {amount}"])

    rows = []
    for i in range(300):
        text = " | ".join(entry() for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.6:
            text += " || ENTREGA: " + " / ".join(entry() for _ in range(rnd.randint(1, 3)))
        elif rnd.random() < 0.2:
            text += " || nada"
        rows.append((i, text))
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.declarado, r.entregado) for r in parse_breakdown(df, "t").collect()}
    for i, text in rows:
        assert got[i] == _py_breakdown(text), text


def test_interval_join_random_against_brute_force(spark):
    rnd = random.Random(17)
    tx_rows = [(i, rnd.randint(0, 3), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 12)), D(1)) for i in range(400)]
    # include bounds equal to some tx times (inclusive ends)
    shifts = []
    for s in range(60):
        t = rnd.randint(0, 4)
        if rnd.random() < 0.1:
            start = dt.datetime(2000, 1, 1)
        elif rnd.random() < 0.3:
            start = rnd.choice(tx_rows)[2]
        else:
            start = T0 + dt.timedelta(minutes=rnd.randint(-600, 60 * 24 * 12))
        end = start + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 4)) if start.year > 2000 else \
            T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 12))
        shifts.append((1000 + s, t, start, end))
    tx = _tx(spark, tx_rows)
    sh = spark.createDataFrame(shifts, "cierre_id long, tienda_id long, desde timestamp_ntz, hasta timestamp_ntz")
    got = sorted((r.cierre_id, r.id) for r in J.tx_in_shift(tx, sh).collect())
    want = sorted((c, i) for c, st, a, b in shifts for i, t, ts, _ in tx_rows if t == st and a <= ts <= b)
    assert got == want and len(want) > 0


@pytest.mark.parametrize("tol,first", [(0.01, False), (0.1, True), (0.1, False)])
def test_band_join_random_against_brute_force(spark, tol, first):
    rnd = random.Random(23)

    def amount():
        base = D(rnd.randint(-300, 300)) / 10
        return base + D(rnd.choice([-11, -10, -9, -1, 0, 1, 9, 10, 11])) / 1000

    a_rows = [(i, rnd.randint(0, 2), T0 + dt.timedelta(minutes=rnd.randint(0, 300)), amount()) for i in range(250)]
    b_rows = [(1000 + i, rnd.randint(0, 2), T0 + dt.timedelta(minutes=rnd.randint(0, 300)), amount()) for i in range(250)]
    schema = "id long, tienda_id long, ts timestamp_ntz, monto decimal(18,3)"
    a = spark.createDataFrame(a_rows, schema)
    b = spark.createDataFrame(b_rows, schema)
    m = J.match_tolerance(a, b, "monto", "monto", "ts", "ts", tol, keys=["tienda_id"], first=first)
    got = sorted((r.id, r.m_id) for r in m.collect())
    pairs = [(ia, ib) for ia, ta, tsa, ma in a_rows for ib, tb, tsb, mb in b_rows
             if ta == tb and tsa.replace(minute=0) == tsb.replace(minute=0) and abs(ma - mb) < D(str(tol))]
    if first:
        best = {}
        for ia, ib in pairs:
            best[ia] = min(best.get(ia, ib), ib)
        pairs = list(best.items())
    assert got == sorted(pairs) and len(pairs) > 0


def test_treasury_post_then_reverse_bank_identity(spark, ledger):
    """Post every treasury command (I6-I13), reverse every log row it wrote
    (I23, default mode): each bank's legs sum to zero. Advance deposits have
    no log row (they are reversed through I25) and are left out."""
    from tillbook.catalog.q_posting import treasury_commands
    from tillbook.operators.reversals import reverse_treasury_log
    cmds = treasury_commands(ledger).filter(~((F.col("tipo_cmd") == "deposito_banco") & F.col("adelantado")))
    out = I.post_treasury_commands(cmds)
    log = out["log"].withColumnRenamed("comando_id", "id")
    ids = log.select("id", F.col("fecha_hora").alias("ts")).distinct()
    rev = reverse_treasury_log(log, ids, out["transacciones"])
    legs = out["postings"].unionByName(rev["postings"]).filter(F.col("cuenta") == "banco")
    sums = legs.groupBy("banco_id").agg(F.sum("monto").alias("s")).collect()
    assert sums and all(r.s == 0 for r in sums)


def test_validate_ledger_reports_each_rule(spark, ledger):
    from tillbook.operators.validation import validate_ledger
    L = dict(ledger.tables())
    bad_users = spark.createDataFrame([(900001, "dup", "Cajero", 3), (900002, "dup", "Jefe", None),
                                       (900003, None, "Admin", 999)], "id long, username string, rol string, tienda_id long")
    L["usuarios"] = L["usuarios"].unionByName(bad_users)
    L["saldos_bancarios"] = L["saldos_bancarios"].unionByName(L["saldos_bancarios"].limit(1))
    got = {(r.tabla, r.regla, r.clave) for r in validate_ledger(L).collect()}
    assert ("usuarios", "unique:username", "dup") in got
    assert ("usuarios", "enum:rol", "900002") in got
    assert ("usuarios", "not_null:username", "900003") in got
    assert ("usuarios", "fk:tienda_id->tiendas", "999") in got
    assert any(r[1] == "unique:banco_id" for r in got)


def test_merge_users_rules(spark):
    users = spark.createDataFrame([(1, "admin", "Admin", None), (2, "ana", "Cajero", 3), (3, "luis", "Cajero", 4)],
                                  "id long, username string, rol string, tienda_id long")
    changes = spark.createDataFrame(
        [("admin", None, None, "eliminar", 1), ("ana", "Contador", 3, "actualizar", 2),
         ("luis", None, None, "eliminar", 3), ("eva", "Cajero", 7, "insertar", 4)],
        "username string, rol string, tienda_id long, accion string, id long")
    got = sorted(tuple(r) for r in I.merge_users(users, changes).collect())
    assert got == [(1, "admin", "Admin", None), (2, "ana", "Contador", None), (4, "eva", "Cajero", 7)]


def test_set_bank_balance_and_commission_history(spark):
    saldos = spark.createDataFrame([(1, D("100.00"), D("10.00")), (2, D("50.00"), D("5.00")), (3, D("7.00"), D("1.00"))],
                                   "banco_id long, saldo decimal(18,2), saldo_inicial decimal(18,2)")
    cmds = spark.createDataFrame([(1, D("20.00"), None), (2, D("8.00"), D("999.00"))],
                                 "banco_id long, saldo_inicial decimal(18,2), saldo_actual decimal(18,2)")
    got = sorted(tuple(r) for r in I.set_bank_balance(saldos, cmds).collect())
    # bank 1: current += 20 - 10; bank 2: explicit; bank 3: untouched
    assert got == [(1, D("110.00"), D("20.00")), (2, D("999.00"), D("8.00")), (3, D("7.00"), D("1.00"))]
    com = spark.createDataFrame([(1, "Retiro", 1, D("0"), D("10"))],
                                "id long, tipo_transaccion string, banco_id long, valor_efectivo decimal(18,2), "
                                "valor_virtual decimal(18,2)")
    ch = spark.createDataFrame([(1, "Retiro", D("0"), D("12"), T0, 5), (1, "Retiro", D("1"), D("12"), T0 + dt.timedelta(days=1), 6)],
                               "banco_id long, tipo_transaccion string, valor_efectivo decimal(18,2), "
                               "valor_virtual decimal(18,2), ts timestamp_ntz, id long")
    hist = sorted((r.version, r.valido_desde, r.valido_hasta) for r in I.upsert_commissions(com, ch).collect())
    assert hist == [(1, dt.datetime(1970, 1, 1), T0), (5, T0, T0 + dt.timedelta(days=1)), (6, T0 + dt.timedelta(days=1), None)]


def test_receive_remits_and_pay_advances_rules(spark):
    rem = spark.createDataFrame([(1, 1, D("5"), T0, "Pendiente", None, None, None, "x"),
                                 (2, 1, D("6"), T0, "Recibido", None, T0, 7, "y"),
                                 (3, 2, D("7"), T0, "Pendiente", None, None, None, "z")],
                                "id long, tienda_id long, monto decimal(18,2), fecha_envio timestamp_ntz, estado string, "
                                "banco_id long, fecha_recepcion timestamp_ntz, usuario_recibe_id long, observaciones string")
    t1 = T0 + dt.timedelta(hours=3)
    cmds = spark.createDataFrame([(1, t1, 9), (2, t1, 9)], "remesa_id long, fecha timestamp_ntz, usuario_id long")
    got = {r.id: (r.estado, r.fecha_recepcion, r.usuario_recibe_id) for r in I.receive_remits(rem, cmds).collect()}
    assert got == {1: ("Recibido", t1, 9), 2: ("Recibido", t1, 9), 3: ("Pendiente", None, None)}
    dep = spark.createDataFrame([(10, 1, D("50"), None, T0, "Pendiente", None), (11, 2, D("60"), "r", T0, "Pagado", T0)],
                                "id long, banco_id long, monto decimal(18,2), referencia string, fecha_hora timestamp_ntz, "
                                "estado string, fecha_pago timestamp_ntz")
    pay = spark.createDataFrame([(10, t1), (11, t1)], "deposito_id long, ts timestamp_ntz")
    out = I.pay_advances(dep, pay)
    assert [(r.comando_id, r.referencia) for r in out["log"].collect()] == [(10, "Pago de Depósito Pendiente")]
    assert {r.id: (r.estado, r.fecha_pago) for r in out["depositos"].collect()} == {10: ("Pagado", t1), 11: ("Pagado", T0)}


def test_close_preview_cleaning(spark):
    from tillbook.plans.closings import close_preview
    forms = spark.createDataFrame([(1, {"banco_0": "1,000.505", "entrega_banco_0": "-5", "banco_Otros": "L 20",
                                        "observaciones": "x"})], "form_id long, form map<string,string>")
    exp = spark.createDataFrame([(1, D("1015.50"))], "form_id long, saldo_teorico decimal(18,2)")
    out = close_preview(forms, exp)
    banks = {r.clave: (r.declarado, r.entregado, r.resto) for r in out["per_bank"].collect()}
    assert banks == {"0": (D("1000.51"), D("5.00"), D("995.51")), "Otros": (D("20.00"), D("0.00"), D("20.00"))}
    t = out["totals"].collect()[0]
    assert (t.total_declarado, t.total_entrega, t.diferencia, t.estado, t.saldo_final) == \
        (D("1020.51"), D("5.00"), D("5.01"), "SOBRA", D("1015.51"))


def test_scan_spreads_one_account_day(spark):
    """All rows lie in one account, on one day, a third of them in one second:
    no range holds more than a small multiple of the average, and the balances
    and as-of rows are those of a plain fold."""
    from tillbook.operators.scans import RANGE, dealt_by_range

    rnd = random.Random(13)
    n = 6000
    rows = []
    for i in range(n):
        seconds = 0 if i % 3 == 0 else rnd.randint(0, 86_399)
        kind = "set" if rnd.random() < 0.01 else "delta"
        rows.append((1, T0.replace(hour=0) + dt.timedelta(seconds=seconds), i, D(rnd.randint(-900, 900)) / 100, kind))
    df = spark.createDataFrame(rows, "acct long, ts timestamp_ntz, seq long, amount decimal(18,2), kind string").repartition(7)
    sizes = [r["count"] for r in dealt_by_range(df, ["acct"], ["ts", "seq"]).groupBy(RANGE).count().collect()]
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) <= 3 * n / len(sizes)
    got = {r.seq: r.saldo for r in running_balance(df, ["acct"], "ts", ["seq"], "amount", "kind").collect()}
    bal = D(0)
    for _, _, seq, amount, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        bal = amount if kind == "set" else bal + amount
        assert got[seq] == bal, seq
    right = df.select(F.col("seq").alias("id"), "acct", F.col("ts").alias("r_ts"), "amount")
    left = df.select("seq", "acct", "ts")
    found = {r.seq: r.r_id for r in J.asof_latest(left, right, "acct", "ts", "r_ts", ["amount"]).collect()}
    last = {}
    for _, ts, seq, _, _ in rows:
        last[ts] = max(last.get(ts, -1), seq)
    assert found == {seq: last[ts] for _, ts, seq, _, _ in rows}


def test_running_balance_without_account_or_rows(spark):
    """Rows without an account form one of their own; no rows give no rows."""
    schema = "acct long, ts timestamp_ntz, seq long, amount decimal(18,2), kind string"
    rows = [(None, T0, 1, D(5), "delta"), (None, T0, 2, D(3), "set"), (None, T0, 3, D(1), "delta"), (4, T0, 4, D(2), "delta")]
    got = {r.seq: r.saldo for r in running_balance(spark.createDataFrame(rows, schema), ["acct"], "ts", ["seq"]).collect()}
    assert got == {1: D(5), 2: D(3), 3: D(4), 4: D(2)}
    assert running_balance(spark.createDataFrame([], schema), ["acct"], "ts", ["seq"]).count() == 0


def test_interval_sums_of_overlapping_shifts(spark):
    """1,000 shifts that overlap, ends on and between transactions: equal to
    a plain sum per shift, and no row per (transaction, shift) in the plan."""
    import contextlib
    import io

    from tillbook.operators.aggregations import shift_by_bank, shift_by_type

    rnd = random.Random(21)
    tx_rows = [(i, rnd.randint(0, 2), rnd.choice([None, 0, 1]), T0 + dt.timedelta(minutes=rnd.randint(0, 300)),
                rnd.choice(["Depósito", "Retiro", None]), D(rnd.randint(-900, 900)) / 100) for i in range(900)]
    tx_rows.append((901, 1, 0, None, "Retiro", D(7)))
    sh_rows = [(k, rnd.randint(0, 3), T0 + dt.timedelta(minutes=rnd.randint(-20, 150)), T0 + dt.timedelta(minutes=rnd.randint(100, 330)))
               for k in range(1000)]
    tx = spark.createDataFrame(tx_rows, "id long, tienda_id long, banco_id long, fecha_hora timestamp_ntz, tipo string, monto_efectivo decimal(18,2)")
    sh = spark.createDataFrame(sh_rows, "cierre_id long, tienda_id long, desde timestamp_ntz, hasta timestamp_ntz")
    want, banks = {}, {}
    for k, t, a, b in sh_rows:
        for _, t2, bank, ts, tipo, m in tx_rows:
            if t2 == t and ts is not None and a <= ts <= b:
                w = want.setdefault((k, tipo), [D(0), D(0), 0])
                w[0] += max(m, D(0))
                w[1] += max(-m, D(0))
                w[2] += 1
                if bank is not None:
                    banks[k, bank] = banks.get((k, bank), D(0)) + m
    by_type = shift_by_type(tx, sh)
    assert {(r.cierre_id, r.tipo): [r.entrada_ef, r.salida_ef, r.cantidad] for r in by_type.collect()} == want
    dim = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "id long, nombre string, color string")
    assert {(r.cierre_id, r.banco_id): r.neto_ef for r in shift_by_bank(tx, sh, dim).collect()} == banks
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        by_type.explain()
    assert "Generate" not in buf.getvalue() and "BroadcastNestedLoopJoin" not in buf.getvalue()


def test_snapshot_batches_are_idempotent(spark):
    """A batch written again replaces its own rows only."""
    import uuid

    from tillbook.session import ensure_checkpoint_dir
    from tillbook.sources.io import read_snapshots, write_snapshot

    schema = "id long, fecha_hora timestamp_ntz"
    path = f"{ensure_checkpoint_dir(spark)}/snap-{uuid.uuid4().hex}"
    day = dt.timedelta(days=1)
    first, second = [(1, T0), (2, T0 + day), (3, None)], [(4, T0), (5, T0 + 2 * day)]
    for batch, rows in (("a", first), ("b", second), ("a", first), ("b", second), ("a", first)):
        write_snapshot(spark.createDataFrame(rows, schema), path, "fecha_hora", batch)
    assert sorted(r.id for r in read_snapshots(spark, path).collect()) == [1, 2, 3, 4, 5]
    plan = read_snapshots(spark, path).filter(F.col("dia") == F.lit(T0.date()))
    assert sorted(r.id for r in plan.collect()) == [1, 4]


def test_validation_scans_a_table_once(spark, ledger):
    import contextlib
    import io
    import re

    from tillbook.operators.validation import row_violations
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        row_violations({t: ledger[t] for t in ("transacciones", "tiendas", "bancos", "usuarios")}, "transacciones").explain("formatted")
    assert len(re.findall(r"Location: .*/transacciones\]", buf.getvalue())) <= 1


def test_business_day_zone_of_day_filters(spark):
    """With a zone, 03:00 UTC belongs to the day before; without one, times
    are local already."""
    from tillbook.functions.timeparse import BUSINESS_ZONE
    from tillbook.operators.aggregations import expenses_by_bank, legacy_transit
    from tillbook.operators.filters import cashiers_without_opening
    from tillbook.operators.reversals import reverse_closings

    night = dt.datetime(2024, 5, 2, 3, 0)  # 21:00 of 1 May in the business zone
    g = spark.createDataFrame([(1, night, 0, D(5))], "id long, fecha_hora timestamp_ntz, banco_id long, monto decimal(18,2)")
    assert expenses_by_bank(g, "2024-05-01").count() == 0
    assert expenses_by_bank(g, "2024-05-01", BUSINESS_ZONE).collect()[0].total == D(5)
    tx = spark.createDataFrame([("Retiro", None, D(-7), night)], "tipo string, banco_id long, monto_efectivo decimal(18,2), fecha_hora timestamp_ntz")
    assert [legacy_transit(tx, "2024-05-01", tz).collect()[0].transito for tz in (None, BUSINESS_ZONE)] == [0, 7]
    u = spark.createDataFrame([(1, "Cajero")], "id long, rol string")
    ap = spark.createDataFrame([(9, 4, 1, "Abierta", night)], "id long, tienda_id long, usuario_id long, estado string, fecha_hora timestamp_ntz")
    assert [cashiers_without_opening(u, ap, "2024-05-01", tz).count() for tz in (None, BUSINESS_ZONE)] == [1, 0]
    ci = spark.createDataFrame([(1, 4, D(10))], "id long, tienda_id long, saldo_teorico decimal(18,2)")
    rem = spark.createDataFrame([(7, 4, "Pendiente", dt.datetime(2024, 5, 1, 20, 0))], "id long, tienda_id long, estado string, fecha_envio timestamp_ntz")
    cmds = spark.createDataFrame([(1, night)], "cierre_id long, ts timestamp_ntz")
    assert [reverse_closings(ci, ap, rem, cmds, tz)["remesas_eliminadas"].count() for tz in (None, BUSINESS_ZONE)] == [0, 1]


def test_edit_users_by_id(spark):
    users = spark.createDataFrame([(1, "admin", "Admin", None), (2, "ana", "Cajero", 3), (3, "luis", "Cajero", 4)],
                                  "id long, username string, rol string, tienda_id long")
    changes = spark.createDataFrame(
        [(2, "ana maria", "Contador", 3, "editar"), (3, "admin", "Cajero", 4, "editar"), (1, "admin", None, None, "eliminar"),
         (8, "luis", "Cajero", 1, "insertar"), (9, "eva", "Cajero", 7, "insertar"), (10, "eva", "Admin", None, "insertar"),
         (77, "x", "Admin", None, "editar")], "id long, username string, rol string, tienda_id long, accion string")
    out = I.edit_users(users, changes)
    assert sorted(tuple(r) for r in out["usuarios"].collect()) == [
        (1, "admin", "Admin", None), (2, "ana maria", "Contador", None), (3, "luis", "Cajero", 4), (9, "eva", "Cajero", 7)]
    assert sorted((r.id, r.motivo) for r in out["rejected"].collect()) == [
        (1, "admin"), (3, "nombre_existente"), (8, "nombre_existente"), (10, "nombre_existente"), (77, "sin_usuario")]
