"""Group D: joins of the ledger.

Broadcast choices are left to Catalyst/AQE: a dimension side is broadcast
only when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``
(file statistics at plan time, shuffle statistics at run time under AQE),
so no side is broadcast without a checked size; above it the planner keeps
the shuffle join.

The non-equi joins never pair rows within a key: the as-of join is a
union of both sides with windows per (key, time bucket) plus a window over
per-bucket summaries; the interval join is an equi-join on (store, day) with
shifts exploded over their days, then an exact range filter; the tolerance
match is a band join on (hour, amount bucket). A store holding a third of
all rows is thus still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.functions.timeparse import ts_literal
from tillbook.sources.schemas import MONEY_SQL

# The lower bound used when a closing has no opening, and the
# text shown for users with no store.
NO_OPENING_SINCE = "2000-01-01 00:00:00"
GLOBAL_ACCESS_LABEL = "Todas (Acceso Global)"


def banks_with_balance(bancos: DataFrame, saldos: DataFrame) -> DataFrame:
    """Banks LEFT JOIN balances (banks without a balance row are kept)."""
    s = saldos.select(F.col("banco_id").alias("_sb"), F.col("saldo").alias("saldo_virtual"),
                      "saldo_inicial")
    return (bancos.join(s, bancos.id == s._sb, "left").drop("_sb"))


def banks_having_balance(bancos: DataFrame, saldos: DataFrame) -> DataFrame:
    """Banks JOIN balances."""
    s = saldos.select(F.col("banco_id").alias("_sb"), "saldo")
    return bancos.join(s, bancos.id == s._sb, "inner").select("id", "nombre", "color", "saldo")


def _names(df: DataFrame, id_col: str, name_col: str, alias: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"_{alias}_id"), F.col(name_col).alias(alias))


def enrich_tx(tx: DataFrame, tiendas: DataFrame, bancos: DataFrame, usuarios: DataFrame) -> DataFrame:
    """D3: transactions with store, bank and user names (three left joins)."""
    t = _names(tiendas, "id", "nombre", "tienda_nombre")
    b = _names(bancos, "id", "nombre", "banco_nombre")
    u = _names(usuarios, "id", "username", "username")
    out = (tx.join(t, tx.tienda_id == t._tienda_nombre_id, "left")
             .join(b, tx.banco_id == b._banco_nombre_id, "left")
             .join(u, tx.usuario_id == u._username_id, "left"))
    return out.drop("_tienda_nombre_id", "_banco_nombre_id", "_username_id")


def enrich_remits(rem: DataFrame, tiendas: DataFrame, bancos: DataFrame) -> DataFrame:
    """Remittances JOIN store LEFT JOIN bank."""
    t = _names(tiendas, "id", "nombre", "tienda_nombre")
    b = _names(bancos, "id", "nombre", "banco_nombre")
    return (rem.join(t, rem.tienda_id == t._tienda_nombre_id, "inner")
               .join(b, rem.banco_id == b._banco_nombre_id, "left")
               .drop("_tienda_nombre_id", "_banco_nombre_id"))


def enrich_log(log: DataFrame, bancos: DataFrame) -> DataFrame:
    """Treasury log with the bank dimension joined twice (source, target)."""
    b1 = _names(bancos, "id", "nombre", "banco_nombre")
    b2 = _names(bancos, "id", "nombre", "banco_destino_nombre")
    return (log.join(b1, log.banco_id == b1._banco_nombre_id, "left")
               .join(b2, log.banco_destino_id == b2._banco_destino_nombre_id, "left")
               .drop("_banco_nombre_id", "_banco_destino_nombre_id"))


def enrich_debts(dep: DataFrame, bancos: DataFrame) -> DataFrame:
    """Advance deposits JOIN bank."""
    b = _names(bancos, "id", "nombre", "banco_nombre")
    return dep.join(b, dep.banco_id == b._banco_nombre_id, "inner").drop("_banco_nombre_id")


def enrich_rules(com: DataFrame, bancos: DataFrame) -> DataFrame:
    """Commission rules JOIN bank (name and colour)."""
    b = bancos.select(F.col("id").alias("_bid"), F.col("nombre").alias("banco_nombre"),
                      F.col("color").alias("banco_color"))
    return com.join(b, com.banco_id == b._bid, "inner").drop("_bid")


def enrich_users(usuarios: DataFrame, tiendas: DataFrame) -> DataFrame:
    """Users LEFT JOIN store; no store reads as global access."""
    t = _names(tiendas, "id", "nombre", "tienda_nombre")
    out = usuarios.join(t, usuarios.tienda_id == t._tienda_nombre_id, "left").drop("_tienda_nombre_id")
    return out.withColumn("tienda_etiqueta", F.coalesce("tienda_nombre", F.lit(GLOBAL_ACCESS_LABEL)))


def enrich_closings(ci: DataFrame, tiendas: DataFrame, usuarios: DataFrame) -> DataFrame:
    """Closings JOIN store JOIN user."""
    t = _names(tiendas, "id", "nombre", "tienda_nombre")
    u = _names(usuarios, "id", "username", "username")
    return (ci.join(t, ci.tienda_id == t._tienda_nombre_id, "inner")
              .join(u, ci.usuario_id == u._username_id, "inner")
              .drop("_tienda_nombre_id", "_username_id"))


def last_opening_ts(ap: DataFrame) -> DataFrame:
    """(tienda_id, ultima_apertura = max opening time); partial aggregation
    happens map-side, so only one row per store and task is shuffled."""
    return ap.groupBy("tienda_id").agg(F.max("fecha_hora").alias("ultima_apertura"))


def since_opening(facts: DataFrame, ap: DataFrame, ts_col: str) -> DataFrame:
    """Facts of stores with an opening, at or after the latest opening.
    The earliest of the latest openings is a bound for every store; as a
    one-row value it reaches the scan, which skips row groups before it."""
    last = last_opening_ts(ap).withColumnRenamed("tienda_id", "_t")
    recent = facts.filter(F.col(ts_col) >= last.agg(F.min("ultima_apertura")).scalar())
    j = recent.join(last, recent.tienda_id == last._t, "inner")
    return j.filter(F.col(ts_col) >= F.col("ultima_apertura")).drop("_t")


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                payload: list[str], prefix: str = "r_") -> DataFrame:
    """As-of join: for every left row, the latest right row with the same key
    and ``right_ts <= left_ts`` (ties on time broken by the larger right id).

    No pairs are generated: both sides are unioned, dealt by ranges of (key,
    time, right rows first), and scanned (see ``scans``): a window
    ``last(right, ignorenulls)`` inside each range and key, and the last right
    row of the ranges before it as the carry."""
    from tillbook.operators.scans import RANGE, dealt_by_range, with_carry, within_range

    r_struct = F.struct(F.col(right_ts).alias("_ts"), F.col("id").alias("_id"),
                        *[F.col(c) for c in payload])
    r_type = right.select(r_struct.alias("s")).schema["s"].dataType
    l_struct = F.struct(*[F.col(c) for c in left.columns])
    l_type = left.select(l_struct.alias("s")).schema["s"].dataType
    r_rows = right.select(F.col(key).alias("_k"), F.col(right_ts).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_o"),
                          F.col("id").alias("_i"), F.lit(0).cast("long").alias("_h"),
                          r_struct.alias("_r"), F.lit(None).cast(l_type).alias("_L"))
    i_type = r_rows.schema["_i"].dataType
    # left rows of one time are told apart by a hash, so that they can be dealt
    l_rows = left.select(F.col(key).alias("_k"), F.col(left_ts).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_o"),
                         F.lit(None).cast(i_type).alias("_i"), F.xxhash64(*left.columns).alias("_h"),
                         F.lit(None).cast(r_type).alias("_r"), l_struct.alias("_L"))
    ordering = ["_t", "_o", "_i", "_h"]
    rows = dealt_by_range(r_rows.unionByName(l_rows).filter(F.col("_k").isNotNull() | (F.col("_o") == 1)), ["_k"], ordering)
    rows = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(within_range(["_k"], ordering)))
    ends = rows.groupBy(RANGE, "_k").agg(F.max_by("_r", F.when(F.col("_o") == 0, F.struct("_t", "_i"))).alias("_end"))
    before = W.partitionBy("_k").orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_prior", F.last("_end", ignorenulls=True).over(before))
    out = with_carry(rows.filter(F.col("_o") == 1), ends, ["_k"], {"_prior": F.col("_prior")})
    chosen = F.when(F.col("_k").isNotNull(), F.coalesce(F.col("_last"), F.col("_prior")))
    sel = [F.col("_L")[c].alias(c) for c in left.columns]
    sel += [chosen["_id"].alias(f"{prefix}id"), chosen["_ts"].alias(f"{prefix}{right_ts}")]
    sel += [chosen[c].alias(f"{prefix}{c}") for c in payload]
    return out.select(*sel)


def asof_opening(ci: DataFrame, ap: DataFrame) -> DataFrame:
    """Each closing with the latest opening of its store at or before it.
    No opening: since = 2000-01-01 and opening cash 0."""
    j = asof_latest(ci, ap, "tienda_id", "fecha", "fecha_hora",
                    ["saldo_inicial_efectivo", "saldos_bancos_json"], prefix="ap_")
    return (j.withColumnRenamed("ap_id", "apertura_id")
             .withColumn("desde", F.coalesce(F.col("ap_fecha_hora"),
                                             F.lit(NO_OPENING_SINCE).cast("timestamp_ntz")))
             .withColumn("saldo_inicial_ef", F.coalesce(F.col("ap_saldo_inicial_efectivo"),
                                                        F.lit(0).cast(MONEY_SQL)))
             .drop("ap_fecha_hora", "ap_saldo_inicial_efectivo"))


def tx_in_shift(tx: DataFrame, shifts: DataFrame, shift_id: str = "cierre_id",
                start: str = "desde", end: str = "hasta") -> DataFrame:
    """Interval join, tx of the store with start <= ts <= end (both ends
    inclusive, so a tx can belong to several shifts).

    Each shift is exploded over the days it covers, clipped to the days
    the store has transactions, and joined on (store, day); the exact bounds
    are then applied. The join key includes the day, so a hot store spreads
    over as many tasks as it has days."""
    tx_days = tx.select("tienda_id", F.to_date("fecha_hora").alias("_d")).distinct()
    span = tx_days.groupBy("tienda_id").agg(F.min("_d").alias("_d0"), F.max("_d").alias("_d1"))
    s = shifts.join(span.withColumnRenamed("tienda_id", "_st"),
                    shifts.tienda_id == F.col("_st"), "inner")
    lo = F.greatest(F.to_date(F.col(start)), F.col("_d0"))
    hi = F.least(F.to_date(F.col(end)), F.col("_d1"))
    s = (s.filter(lo <= hi)
          .select(F.col(shift_id), F.col("tienda_id").alias("_s_tienda"), F.col(start).alias("_start"),
                  F.col(end).alias("_end"), F.explode(F.sequence(lo, hi)).alias("_sd")))
    t = tx.withColumn("_td", F.to_date("fecha_hora"))
    j = t.join(s, (t.tienda_id == s._s_tienda) & (t._td == s._sd), "inner")
    j = j.filter((F.col("fecha_hora") >= F.col("_start")) & (F.col("fecha_hora") <= F.col("_end")))
    return j.drop("_td", "_sd", "_s_tienda", "_start", "_end")


def semi_latest(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Rows whose id is the max id of their key (``id IN (SELECT MAX(id)
    ... GROUP BY key)``), as a left semi join on the per-key max."""
    mx = df.groupBy(key).agg(F.max(id_col).alias("_mx"))
    return df.join(mx.select(F.col("_mx")), F.col(id_col) == F.col("_mx"), "left_semi")


def id_array(dim: DataFrame, col: str = "id") -> Column:
    """The sorted ids of a dimension as one array value: a lazy scalar
    subquery, so no job runs while the plan is built. For dimensions (banks),
    whose ids fit one row by the data model."""
    return dim.agg(F.sort_array(F.collect_set(col)).alias("ids")).scalar()


def densify(df: DataFrame, tiendas: DataFrame, bancos: DataFrame, value_cols: list[str],
            fill: float = 0) -> DataFrame:
    """Every (store, bank) pair, missing values -> ``fill``.

    The grid is generated by exploding the array of bank ids on the store
    rows, not by a join, then facts are left-joined on the pair."""
    grid = tiendas.select(F.col("id").alias("tienda_id"), F.explode(id_array(bancos)).alias("banco_id"))
    f = df.withColumnRenamed("tienda_id", "_ft").withColumnRenamed("banco_id", "_fb")
    j = grid.join(f, (grid.tienda_id == f._ft) & (grid.banco_id == f._fb), "left")
    out = j.drop("_ft", "_fb")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(fill).cast(df.schema[c].dataType)))
    return out


def join_nullsafe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where NULL keys match each other (NULL bank = 'Otros')."""
    bb = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                  *[F.col(c) for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(bb[f"_r_{k}"])
        cond = c if cond is None else cond & c
    j = a.join(bb, cond, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        for k in keys:
            j = j.withColumn(k, F.when(a[k].isNotNull() | bb[f"_r_{k}"].isNull(), a[k])
                             .otherwise(bb[f"_r_{k}"]))
    return j.drop(*[f"_r_{k}" for k in keys])


# Treasury flow terms per log type (sign of the amount).
TREASURY_INFLOW_LOG_TYPES = ["Traslado (Efectivo)"]
TREASURY_OUTFLOW_LOG_TYPES = ["Depósito a Banco", "Envío a Tienda", "Entrega Dueño",
                              "Pago Depósito Adelantado", "Ajuste de Cuadre"]


def flow_terms(rem: DataFrame, log: DataFrame, since=None, until=None) -> DataFrame:
    """Signed treasury flow rows (banco_id, flujo) strictly after ``since``
    (and at or before ``until``): received remittances and cash transfers in,
    treasury outflows out.

    ``since`` / ``until`` are None (no cut), a literal timestamp, or a Column."""
    def after(c: str) -> Column:
        cond = F.col(c).isNotNull() if since is None else F.col(c) > ts_literal(since)
        return cond if until is None else cond & (F.col(c) <= ts_literal(until))
    r = rem.filter((F.col("estado") == "Recibido") & after("fecha_recepcion")) \
           .select("banco_id", F.col("monto").alias("flujo"))
    inflow = log.filter(F.col("tipo").isin(TREASURY_INFLOW_LOG_TYPES) & after("fecha_hora")) \
                .select("banco_id", F.col("monto").alias("flujo"))
    outflow = log.filter(F.col("tipo").isin(TREASURY_OUTFLOW_LOG_TYPES) & after("fecha_hora")) \
                 .select("banco_id", (-F.col("monto")).cast(MONEY_SQL).alias("flujo"))
    return r.unionByName(inflow).unionByName(outflow)


def with_commission(cmds: DataFrame, com: DataFrame, tipo_col: str = "tipo",
                    bank_col: str = "banco_id") -> DataFrame:
    """First rule (lowest id) for (bank, type), else 0. A NULL bank never
    matches a rule (plain equality)."""
    rules = (com.groupBy("banco_id", "tipo_transaccion")
                .agg(F.min_by("valor_efectivo", "id").alias("_ce"),
                     F.min_by("valor_virtual", "id").alias("_cv"))
                .withColumnRenamed("banco_id", "_rb"))
    j = cmds.join(rules, (cmds[bank_col] == rules._rb) & (cmds[tipo_col] == rules.tipo_transaccion), "left")
    zero = F.lit(0).cast(MONEY_SQL)
    return (j.withColumn("com_ef", F.coalesce("_ce", zero).cast(MONEY_SQL))
             .withColumn("com_vi", F.coalesce("_cv", zero).cast(MONEY_SQL))
             .drop("_rb", "tipo_transaccion", "_ce", "_cv"))


def match_tolerance(a: DataFrame, b: DataFrame, a_amount: str, b_amount: str, a_ts: str, b_ts: str,
                    tol: float, keys: list[str] | None = None, first: bool = False,
                    b_id: str = "id") -> DataFrame:
    """Pairs with the same hour bucket (and keys) and |a - b| < tol.

    ``first``: keep only the lowest-id match of each ``a`` row. Both sides are
    then reduced to one row per (hour, keys, amount) before they meet, so many
    equal amounts in one hour give no pairs: the work stays linear.

    Band join: besides the hour and the keys, the equi key holds the amount
    bucket floor(amount / tol); each ``b`` row is exploded to its bucket and
    the two neighbours, then the exact |a - b| < tol filter applies. A row
    therefore meets only candidates whose amounts are within 2 * tol, even in
    an hour that holds a large share of all rows."""
    keys = keys or []
    width = F.lit(tol).cast("decimal(18,6)")
    if first:
        slot = [F.date_trunc("hour", F.col(a_ts)).alias("_hr"), *[F.col(k) for k in keys], F.col(a_amount).alias("_am")]
        left = a.select(*slot).distinct()
        right = (b.groupBy(F.date_trunc("hour", F.col(b_ts)).alias("_hr"), *keys, F.col(b_amount).alias("_am"))
                  .agg(F.min_by(F.struct(*b.columns), F.col(b_id)).alias("_m"), F.min(b_id).alias("_first")))
        best = band_join(left, right, ["_hr", *keys], width, tol)
        best = best.groupBy("_hr", *keys, "_am").agg(F.min_by("_m", "_first").alias("_m"))
        names = ["_hr", *keys, "_am"]
        best = best.select(*[F.col(c).alias(f"_s{n}") for n, c in enumerate(names)], "_m")
        cond = None
        for n, c in enumerate([F.date_trunc("hour", a[a_ts]), *[a[k] for k in keys], a[a_amount]]):
            cond = (c == F.col(f"_s{n}")) if cond is None else cond & (c == F.col(f"_s{n}"))
        return a.join(best, cond, "inner").select(*[a[c] for c in a.columns],
                                                  *[F.col("_m")[c].alias(f"m_{c}") for c in b.columns])
    a2 = (a.withColumn("_hr", F.date_trunc("hour", F.col(a_ts)))
           .withColumn("_ab", F.floor(F.col(a_amount) / width).cast("long")))
    bsel = b.select(*[F.col(c).alias(f"m_{c}") for c in b.columns]) \
            .withColumn("_hr2", F.date_trunc("hour", F.col(f"m_{b_ts}")))
    bb = F.floor(F.col(f"m_{b_amount}") / width).cast("long")
    bsel = bsel.withColumn("_bb", F.explode(F.array(bb - 1, bb, bb + 1)))
    cond = (a2._hr == bsel._hr2) & (a2._ab == bsel._bb) & \
        (F.abs(F.col(a_amount) - F.col(f"m_{b_amount}")) < F.lit(tol))
    for k in keys:
        cond = cond & (a2[k] == bsel[f"m_{k}"])
    return a2.join(bsel, cond, "inner").drop("_hr", "_hr2", "_ab", "_bb")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], width: Column, tol: float) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of equal keys whose ``_am``
    differs by less than ``tol``; the left ``_am`` is kept. With one row per
    amount on either side a row meets as many as there are cents in 2 * tol."""
    bucket = F.floor(F.col("_am") / width).cast("long")
    r = right.select(*keys, F.col("_am").alias("_am2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_ab"),
                     *[c for c in right.columns if c not in (*keys, "_am")])
    return (left.withColumn("_ab", bucket).join(r, [*keys, "_ab"], "inner")
            .filter(F.abs(F.col("_am") - F.col("_am2")) < F.lit(tol)).drop("_ab", "_am2"))


def attach_closing(refs: DataFrame, ci: DataFrame) -> DataFrame:
    """Latest closing (max id per store) attached only when the till is
    closed (``estado_caja == 'Cerrada'``)."""
    last = semi_latest(ci, "tienda_id").select(F.col("tienda_id").alias("_ct"),
                                               F.col("id").alias("_cid"))
    j = refs.join(last, refs.tienda_id == last._ct, "left")
    return j.withColumn("cierre_id", F.when(F.col("estado_caja") == "Cerrada", F.col("_cid"))) \
            .drop("_ct", "_cid")
