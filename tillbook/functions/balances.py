"""B3 explode_balances, B7 nullable_bank, B9 snapshot_json.

Balance maps are JSON text keyed by bank id (text) or ``Otros``. Values may
be numbers or quoted numbers, so the map is read as map<string,string> and
each value is cast on its own (one quoted value must not null the map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.sources.schemas import MONEY_SQL

# The map key that stands for cash with no bank.
OTHERS_KEY = "Otros"


def balance_map(col: Column | str) -> Column:
    """JSON text -> map<string,string>; invalid or NULL text -> empty map."""
    c = F.col(col) if isinstance(col, str) else col
    parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def map_amount(m: Column, key: Column | str) -> Column:
    """``parseFloat(map[key] || 0)``: missing or unparseable -> 0."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.element_at(m, k).try_cast(MONEY_SQL), F.lit(0).cast(MONEY_SQL))


def map_total(m: Column) -> Column:
    """Sum of all values of a balance map (unparseable values count 0)."""
    vals = F.transform(F.map_values(m), lambda v: F.coalesce(v.try_cast(MONEY_SQL),
                                                              F.lit(0).cast(MONEY_SQL)))
    return F.aggregate(vals, F.lit(0).cast("decimal(38,2)"), lambda a, b: a + b).cast(MONEY_SQL)


def explode_balances(df: DataFrame, json_col: str, key_col: str = "bal_key",
                     amount_col: str = "bal_amount") -> DataFrame:
    """One row per map entry; invalid JSON gives no rows."""
    m = balance_map(json_col)
    return (df.select("*", F.explode(m).alias(key_col, "_v"))
              .withColumn(amount_col, F.col("_v").try_cast(MONEY_SQL))
              .drop("_v"))


def nullable_bank(col: Column | str) -> Column:
    """'' / 'Otros' / missing / non-numeric -> NULL bank id, else the id."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.when(c.isNull() | (c == "") | (c == OTHERS_KEY), F.lit(None).cast("long")) \
            .otherwise(c.try_cast("long"))


def bank_key(bank_id: Column | str) -> Column:
    """Bank id -> map key text; NULL bank -> 'Otros'."""
    c = F.col(bank_id) if isinstance(bank_id, str) else bank_id
    return F.coalesce(c.cast("string"), F.lit(OTHERS_KEY))


def js_number_text(amount: Column) -> Column:
    """Decimal -> the text a JS ``JSON.stringify`` prints (no trailing zeros)."""
    t = amount.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(t, "0+$", ""), "[.]$", "")
    return F.when(t.contains("."), trimmed).otherwise(t)


def snapshot_json(df: DataFrame, keys: list[str], key_col: str, amount_col: str,
                  out_col: str = "saldos_json") -> DataFrame:
    """Per group of ``keys``: balances -> JSON object text in JS key order
    (integer-like keys ascending, then other keys such as 'Otros')."""
    entry = F.struct(
        F.when(F.col(key_col).rlike(r"^[0-9]+$"), F.lit(0)).otherwise(F.lit(1)).alias("o1"),
        F.when(F.col(key_col).rlike(r"^[0-9]+$"), F.col(key_col).try_cast("long")).alias("o2"),
        F.col(key_col).alias("o3"),
        F.concat(F.lit('"'), F.col(key_col), F.lit('":'), js_number_text(F.col(amount_col))).alias("kv"),
    )
    agg = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return agg.select(*keys, F.concat(F.lit("{"), F.array_join(F.transform("_e", lambda e: e["kv"]), ","),
                                      F.lit("}")).alias(out_col))
