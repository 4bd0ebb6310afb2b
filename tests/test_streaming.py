"""Streaming behaviour over several micro-batches (one file per trigger)."""

import datetime as dt
import random
import tempfile
from decimal import Decimal

from tillbook.streaming import live as J
from tillbook.streaming.keyed import pending_events

T0 = dt.datetime(2024, 1, 1, 8, 0)
SCHEMA = "id long, fecha_envio timestamp_ntz, estado string"
HOUR = dt.timedelta(hours=1)


class Files:
    """A folder to which a test adds one file per micro-batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.path = tempfile.mkdtemp(prefix="tb-src-")
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)


def _changes(spark, out):
    return sorted((r.epoch, r.clase, r.pendientes, r.primer_id) for r in spark.read.parquet(out + "/changes").collect())


def test_receipts_lower_the_count_and_the_head_moves_on(spark):
    sent, debts = Files(spark, SCHEMA), Files(spark, SCHEMA)
    events = (pending_events(sent.stream, "remesa", "fecha_envio", closed=False)
              .unionByName(pending_events(debts.stream, "deuda", "fecha_envio", closed=False)))
    out = J.scratch_path(spark, "t-j2")
    steps = [([(1, T0, "Pendiente"), (2, T0 + HOUR, "Pendiente"), (3, T0 + 2 * HOUR, "Pendiente")], [(1, T0, "Pendiente")]),
             ([(3, T0 + 2 * HOUR, "Recibido")], []),  # the head is received
             ([(3, T0 + 2 * HOUR, "Recibido"), (2, T0 + HOUR, "Pendiente")], []),  # delivered again: no change
             ([(9, T0 + 3 * HOUR, "Recibido")], [(1, T0, "Pagado")]),  # a receipt before its sending
             ([(9, T0 + 3 * HOUR, "Pendiente")], [(4, None, "Pendiente")])]
    for rem, debt in steps:
        for files, rows in ((sent, rem), (debts, debt)):
            files.add(rows or [(None, None, None)])
        J.run_pending_changes(events, out).awaitTermination()
    assert [(c, n, i) for _, c, n, i in _changes(spark, out) if c == "remesa"] == [("remesa", 3, 3), ("remesa", 2, 2)]
    assert [(c, n, i) for _, c, n, i in _changes(spark, out) if c == "deuda"] == [("deuda", 1, 1), ("deuda", 0, None), ("deuda", 1, 4)]


def test_pending_set_against_a_fold(spark):
    """Random sendings and receipts in any order over several batches."""
    rnd = random.Random(3)
    times = {i: T0 + dt.timedelta(minutes=rnd.randint(0, 500)) for i in range(60)}
    events = [(i, t, "Pendiente") for i, t in times.items()] + [(i, times[i], "Recibido") for i in range(0, 60, 2)]
    rnd.shuffle(events)
    files, out, seen, want = Files(spark, SCHEMA), J.scratch_path(spark, "t-j2f"), {}, []
    stream = pending_events(files.stream, "remesa", "fecha_envio", closed=False)
    for k in range(0, 90, 15):
        files.add(events[k:k + 15])
        J.run_pending_changes(stream, out).awaitTermination()
        for i, t, e in events[k:k + 15]:
            seen[i] = seen.get(i, True) and e == "Pendiente"
        open_ = [(times[i], i) for i, o in seen.items() if o]
        state = (len(open_), max(open_)[1] if open_ else None)
        if not want or want[-1] != state:
            want.append(state)
    assert [(n, i) for _, _, n, i in _changes(spark, out)] == want


def test_pending_items_lie_in_small_parts(spark):
    """Every part of a class holds a small share of its items (its rows of a
    batch are one task's work), and the parts add up to what was delivered."""
    files, out = Files(spark, SCHEMA), J.scratch_path(spark, "t-j2p")
    files.add([(i, T0 + dt.timedelta(seconds=i), "Recibido" if i % 5 == 0 else "Pendiente") for i in range(4002)])
    J.run_pending_changes(pending_events(files.stream, "remesa", "fecha_envio"), out).awaitTermination()
    assert [(n, i) for _, _, n, i in _changes(spark, out)] == [(3201, 4001)]
    parts = [r.pendientes for r in spark.read.parquet(out + "/data").collect()]
    assert sum(parts) == 3201 and max(parts) <= 0.02 * sum(parts)


def test_pending_item_delivered_many_times(spark):
    """One item's deliveries come in several Arrow batches and stretches: its
    last known time counts, and nothing opens it after its receipt."""
    files, out = Files(spark, SCHEMA), J.scratch_path(spark, "t-j2h")
    steps = [([(1, T0 + HOUR, "Pendiente")] * 900 + [(1, None, "Pendiente")] * 300 + [(2, T0, "Pendiente")], (2, 1)),
             ([(2, T0 + 3 * HOUR, "Pendiente")], (2, 2)),  # a new time makes it the head
             ([(2, T0 - HOUR, "Pendiente")], (2, 1)),  # and another one puts it behind again
             ([(1, None, "Recibido")] + [(1, T0 + 9 * HOUR, "Pendiente")] * 700, (1, 2)),
             ([(2, None, "Recibido")], (0, None))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for rows, _ in steps:
            files.add(rows)
            J.run_pending_changes(pending_events(files.stream, "remesa", "fecha_envio", closed=False), out).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(n, i) for _, _, n, i in _changes(spark, out)] == [want for _, want in steps]


def test_stretches_fold_like_one(spark, monkeypatch):
    """A part's rows give the same state however they are cut into frames."""
    import pandas as pd

    from tillbook.streaming import keyed

    class Kept:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rnd = random.Random(5)
    rows = pd.DataFrame([(rnd.randint(0, 40), rnd.choice([keyed.NO_TIME, rnd.randint(0, 99)]), rnd.random() < 0.97)
                         for _ in range(600)], columns=["id", "ts", "abierto"])
    found = []
    for size, stretch in ((600, 100_000), (7, 1), (50, 60)):
        monkeypatch.setattr(keyed, "FOLD_ROWS", stretch)
        state = Kept()
        frames = [rows[k:k + size] for k in range(0, 600, size)]
        last = [list(keyed.pending_set(("remesa", 0), iter(part), state)) for part in (frames[:3], frames[3:]) if part][-1]
        found.append((state.get, last and last[0].values.tolist()))
    want = {}
    for i, t, o in rows.itertuples(index=False):
        old = want.get(i, (keyed.NO_TIME, True))
        want[i] = (t if t != keyed.NO_TIME else old[0], old[1] and o)
    open_ = [(t, i) for i, (t, o) in want.items() if o]
    assert found[0][0] == found[1][0] == found[2][0]
    assert found[0][0][:3] == (len(open_), *max(open_))


def test_live_trigger_runs_and_stops(spark):
    files, out = Files(spark, SCHEMA), J.scratch_path(spark, "t-live")
    files.add([(1, T0, "Pendiente")])
    files.add([(2, T0 + HOUR, "Pendiente")])
    q = J.run_pending_changes(pending_events(files.stream, "remesa", "fecha_envio"), out, trigger=J.LIVE_TRIGGER)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert _changes(spark, out)[-1][2:] == (2, 2)


TX = "id long, tienda_id long, banco_id long, fecha_hora timestamp_ntz, monto_efectivo decimal(18,2)"
AP = "tienda_id long, fecha_hora timestamp_ntz"


def test_an_opening_that_arrives_later_resets_the_net(spark):
    """Openings in files of their own, behind and before their transactions:
    after every batch the net is that of a batch computation over what came."""
    rnd = random.Random(8)
    tx, ap, out = Files(spark, TX), Files(spark, AP), J.scratch_path(spark, "t-j1")
    all_tx, all_ap = [], []
    for batch in range(5):
        new_tx = [(100 * batch + i, rnd.randint(0, 2), rnd.choice([None, 0, 1]), T0 + dt.timedelta(minutes=rnd.randint(0, 400)),
                   Decimal(rnd.randint(-999, 999)) / 100) for i in range(40)]
        new_ap = [] if batch == 0 else [(rnd.randint(0, 1), T0 + dt.timedelta(minutes=rnd.randint(0, 380))) for _ in range(2)]
        new_tx.append((999, 1, 0, None, Decimal(5)))
        tx.add(new_tx)
        ap.add(new_ap or [(None, None)])
        all_tx, all_ap = all_tx + new_tx, all_ap + new_ap
        J.run_net(tx.stream, ap.stream, out).awaitTermination()
        last = {}
        for t, ts in all_ap:
            last[t] = max(last.get(t, ts), ts)
        want = {}
        for _, t, b, ts, m in all_tx:
            if t in last and ts is not None and ts >= last[t]:
                want[t, b] = want.get((t, b), Decimal(0)) + m
        assert {(r.tienda_id, r.banco_id): r.neto_txn for r in J.current_net(spark, out).collect()} == want
    assert want


def test_a_batch_reads_only_the_version_before_it(spark):
    """The state a batch reads does not grow with the number of batches."""
    schema = "id long, fecha_hora timestamp_ntz, tipo string, monto_efectivo decimal(18,2)"
    files, out = Files(spark, schema), J.scratch_path(spark, "t-j4n")
    for k in range(12):
        files.add([(10 * k + i, T0 + dt.timedelta(days=k), "a", Decimal(i + 1)) for i in range(5)])
    J.run_daily_flow(files.stream, out, "1 hour").awaitTermination()
    sizes = {r.lote: r["count"] for r in spark.read.parquet(out + "/sumas").groupBy("lote").count().collect()}
    assert len(sizes) == 12 and max(sizes.values()) <= 2
    flow = spark.read.parquet(out + "/flujo").collect()
    assert len(flow) == 11 and {(r.entrada, r.ops) for r in flow} == {(Decimal(15), 5)}


def test_repeated_delivery_posts_once(spark):
    cmd_schema = ("id long, fecha_hora timestamp_ntz, tienda_id long, banco_id long, usuario_id long, "
                  "tipo string, monto decimal(18,2), referencia string")
    src = tempfile.mkdtemp(prefix="tb-cmd-")
    row = (7, T0, 1, None, 1, "Depósito", Decimal("10"), "r")
    for i in range(2):  # the same command delivered twice, in two files
        spark.createDataFrame([row], cmd_schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(cmd_schema).option("maxFilesPerTrigger", 1) \
                  .option("recursiveFileLookup", "true").parquet(src)
    com = spark.createDataFrame([], "id long, tipo_transaccion string, banco_id long, "
                                    "valor_efectivo decimal(18,2), valor_virtual decimal(18,2)")
    out = J.scratch_path(spark, "t-j3")
    J.run_post(stream, com, out).awaitTermination()
    assert spark.read.parquet(out + "/postings").count() == 1


def test_late_and_repeated_commands_of_many_files_post_once(spark):
    """A table of many part files, out of time order and with repeats: every
    distinct command is posted once, in one batch or in many."""
    schema = ("id long, fecha_hora timestamp_ntz, tienda_id long, banco_id long, usuario_id long, "
              "tipo string, monto decimal(18,2), referencia string")
    folder = tempfile.mkdtemp(prefix="tb-parts-")
    rows = [(i, T0 + dt.timedelta(days=(i * 37) % 50), i % 3, None, 1, "Depósito", Decimal(i), "r") for i in range(60)]
    spark.createDataFrame(rows + rows[::7], schema).repartition(9).write.parquet(f"{folder}/events.parquet")
    com = spark.createDataFrame([], "id long, tipo_transaccion string, banco_id long, "
                                    "valor_efectivo decimal(18,2), valor_virtual decimal(18,2)")
    for max_files in (None, 4):
        out = J.scratch_path(spark, "t-parts")
        J.run_post(J.table_stream(spark, folder, "events", max_files), com, out).awaitTermination()
        posted = sorted(r.fuente_id for r in spark.read.parquet(out + "/postings").collect())
        assert posted == list(range(1, 60))
        assert [r.id for r in spark.read.parquet(out + "/rechazados").collect()] == [0]


def test_daily_flow_keeps_late_rows(spark):
    """Files out of time order: rows of a day that was emitted before are in
    the late table, and no money is lost between the two."""
    schema = "id long, fecha_hora timestamp_ntz, tipo string, monto_efectivo decimal(18,2)"
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    batches = [[(1, T0, "a", Decimal("10")), (2, T0 + day, "a", Decimal("-3"))],
               [(3, T0 + hour, "a", Decimal("5")), (4, T0 + day + hour, "a", Decimal("7")), (5, None, "a", Decimal("1"))],
               [(6, T0 + 3 * day, "a", Decimal("2"))],
               [(7, T0 + 2 * day, "b", Decimal("-4")), (8, T0 + 3 * day, "a", Decimal("6"))]]
    src = tempfile.mkdtemp(prefix="tb-late-")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = J.scratch_path(spark, "t-j4")
    for i, rows in enumerate(batches):  # one micro-batch each, in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        J.run_daily_flow(stream, out, "1 hour").awaitTermination()
    flow = sorted((r.dia_inicio.day, r.tipo, r.entrada, r.salida, r.ops) for r in spark.read.parquet(out + "/flujo").collect())
    assert flow == [(1, "a", Decimal("10"), Decimal("0"), 1), (2, "a", Decimal("7"), Decimal("3"), 2)]
    assert sorted(r.id for r in spark.read.parquet(out + "/tardias").collect()) == [3, 5, 7]
