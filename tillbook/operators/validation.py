"""Group A contracts: A3 validation report, A6 NULL-bank repair, A8 resets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.sources.schemas import MONEY_SQL

# The role vocabulary of users.
ROLES = ["Admin", "Contador", "Cajero"]
# (table, column, referenced table) foreign keys checked by A3.
FOREIGN_KEYS = [
    ("usuarios", "tienda_id", "tiendas"), ("transacciones", "tienda_id", "tiendas"),
    ("transacciones", "banco_id", "bancos"), ("transacciones", "usuario_id", "usuarios"),
    ("saldos_bancarios", "banco_id", "bancos"), ("comisiones", "banco_id", "bancos"),
    ("cierres_caja", "tienda_id", "tiendas"), ("cierres_caja", "usuario_id", "usuarios"),
]
NOT_NULL = [("tiendas", "nombre"), ("bancos", "nombre"), ("usuarios", "username"), ("usuarios", "rol"),
            ("transacciones", "tipo")]


# (table, column) whose values must be unique.
UNIQUE = [("usuarios", "username"), ("saldos_bancarios", "banco_id")]


def row_violations(L, table: str) -> DataFrame:
    """The rules of one table that concern a row by itself, in one pass: every
    row is joined once with each dimension it names, tagged with an array of
    the rules it breaks, and the array is exploded."""
    df = L[table]
    broken = [(F.col(c).isNull(), f"not_null:{c}", "id") for t, c in NOT_NULL if t == table]
    if table == "usuarios":
        broken.append((~F.col("rol").isin(ROLES), "enum:rol", "id"))
    for c, ref in [(c, ref) for t, c, ref in FOREIGN_KEYS if t == table]:
        known = L[ref].select(F.col("id").alias(f"_{c}")).distinct()
        df = df.join(known, df[c] == known[f"_{c}"], "left")
        broken.append((F.col(c).isNotNull() & F.col(f"_{c}").isNull(), f"fk:{c}->{ref}", c))
    tags = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("regla"), F.col(key).cast("string").alias("clave"))) for bad, rule, key in broken])
    return (df.select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("v"))
            .select(F.lit(table).alias("tabla"), "v.regla", "v.clave"))


def validate_ledger(L) -> DataFrame:
    """A3: one row per violation (table, rule, key): NOT NULL columns, unique
    usernames, role enum, foreign keys (NULL keys are not violations),
    duplicate balance rows per bank. Each table is scanned once for the rules
    on its rows, and once more where a column must be unique."""
    tables = dict.fromkeys([*(t for t, *_ in NOT_NULL), *(t for t, *_ in FOREIGN_KEYS)])
    out = [row_violations(L, t) for t in tables]
    for t, c in UNIQUE:
        dup = L[t].groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out.append(dup.select(F.lit(t).alias("tabla"), F.lit(f"unique:{c}").alias("regla"), F.col(c).cast("string").alias("clave")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def repair_null_bank(tx: DataFrame, rem: DataFrame, bank_id: int) -> dict[str, DataFrame]:
    """Give ``bank_id`` to cash handovers with no bank and to Pendiente /
    Recibido remittances with no bank; report the counts fixed."""
    fix_tx = (F.col("tipo") == "Efectivo Entregado") & F.col("banco_id").isNull()
    fix_rem = F.col("estado").isin("Pendiente", "Recibido") & F.col("banco_id").isNull()
    tx2 = tx.withColumn("banco_id", F.when(fix_tx, F.lit(bank_id).cast("long")).otherwise(F.col("banco_id")))
    rem2 = rem.withColumn("banco_id", F.when(fix_rem, F.lit(bank_id).cast("long")).otherwise(F.col("banco_id")))
    counts = (tx.select(fix_tx.cast("int").alias("t"), F.lit(0).alias("r"))
              .unionByName(rem.select(F.lit(0).alias("t"), fix_rem.cast("int").alias("r")))
              .agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("transacciones_corregidas"),
                   F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("remesas_corregidas")))
    return {"transacciones": tx2, "remesas": rem2, "conteos": counts}


def latest_state_reset(L, scope: str) -> dict[str, DataFrame]:
    """Reset as an epoch cut, written to a new path by the caller.

    * ``operational``: dimensions kept, store cash and bank balances (current
      and opening) zeroed, transactions, openings, closings, remittances,
      treasury log and expenses dropped (treasury snapshots and debts are
      kept).
    * ``treasury``: treasury log, snapshots and debts dropped, bank balances
      zeroed; remittances kept only while Pendiente."""
    out = dict(L.items()) if hasattr(L, "items") else dict(L.tables())
    empty = lambda t: out[t].limit(0)
    zero = F.lit(0).cast(MONEY_SQL)
    if scope == "operational":
        out["tiendas"] = out["tiendas"].withColumn("efectivo_actual", F.lit(0).cast(MONEY_SQL))
        out["saldos_bancarios"] = out["saldos_bancarios"].withColumn("saldo", zero).withColumn("saldo_inicial", zero)
        for t in ("transacciones", "aperturas_caja", "cierres_caja", "remesas", "tesoreria_log", "gastos"):
            out[t] = empty(t)
    elif scope == "treasury":
        for t in ("tesoreria_log", "cierres_tesoreria", "depositos_adelantados"):
            out[t] = empty(t)
        out["saldos_bancarios"] = out["saldos_bancarios"].withColumn("saldo", zero)
        out["remesas"] = out["remesas"].filter(F.col("estado") == "Pendiente")
    else:
        raise ValueError(f"unknown reset scope {scope!r}")
    return out
