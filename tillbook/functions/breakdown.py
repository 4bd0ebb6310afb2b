"""B4a parse_breakdown and B4b build_breakdown: the closing breakdown text.

Grammar: ``k: L 0.00 | k: L 0.00 || ENTREGA: k: L 0.00 / k: L 0.00`` where
k is a bank id as text or 'Otros'. Entries that do not match the entry
pattern (e.g. negative amounts) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.sources.schemas import MONEY_SQL

# Separators and entry pattern of the breakdown text.
PART_SEP = "||"
DECLARED_SEP = "|"
DELIVERED_SEP = "/"
DELIVERY_TAG = "ENTREGA:"
ENTRY_PATTERN = r"^(.+?):\s*L\s*([\d.,]+)$"


def _entries(text: Column, sep_regex: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), sep_regex)
    structs = F.transform(parts, lambda s: F.struct(
        F.trim(F.regexp_extract(F.trim(s), ENTRY_PATTERN, 1)).alias("k"),
        F.regexp_replace(F.regexp_extract(F.trim(s), ENTRY_PATTERN, 2), ",", "")
         .try_cast(MONEY_SQL).alias("v"),
        F.trim(s).rlike(ENTRY_PATTERN).alias("ok")))
    kept = F.filter(structs, lambda e: e["ok"])
    return F.transform(kept, lambda e: F.struct(e["k"].alias("k"),
                                               F.coalesce(e["v"], F.lit(0).cast(MONEY_SQL)).alias("v")))


def _to_map(entries: Column) -> Column:
    """Entries -> map; the last value wins on a repeated key (JS object
    assignment), without relying on the session's map-key dedup policy."""
    empty = F.create_map().cast(f"map<string,{MONEY_SQL}>")
    return F.aggregate(entries, empty, lambda acc, e: F.map_concat(
        F.map_filter(acc, lambda k, _v: k != e["k"]), F.create_map(e["k"], e["v"])))


def parse_breakdown(df: DataFrame, text_col: str = "desglose_bancos") -> DataFrame:
    """Adds ``declarado`` and ``entregado`` maps and ``total_entregado``."""
    text = F.col(text_col)
    first = F.try_element_at(F.split(F.coalesce(text, F.lit("")), r"\|\|"), F.lit(1))
    second = F.coalesce(F.try_element_at(F.split(F.coalesce(text, F.lit("")), r"\|\|"), F.lit(2)), F.lit(""))
    delivered_text = F.when(second.contains(DELIVERY_TAG),
                            F.regexp_replace(second, DELIVERY_TAG, "")).otherwise(F.lit(""))
    dec = _to_map(_entries(first, r"\|"))
    dlv = _to_map(_entries(delivered_text, "/"))
    total = F.aggregate(F.map_values(dlv), F.lit(0).cast("decimal(38,2)"), lambda a, b: a + b)
    return (df.withColumn("declarado", dec).withColumn("entregado", dlv)
              .withColumn("total_entregado", total.cast(MONEY_SQL)))


def breakdown_long(df: DataFrame, id_cols: list[str], text_col: str = "desglose_bancos") -> DataFrame:
    """Long form: one row per (part, key) with its amount."""
    p = parse_breakdown(df, text_col)
    dec = p.select(*id_cols, F.lit("declarado").alias("parte"),
                   F.explode("declarado").alias("clave", "monto"))
    dlv = p.select(*id_cols, F.lit("entregado").alias("parte"),
                   F.explode("entregado").alias("clave", "monto"))
    return dec.unionByName(dlv)


def money_text(amount: Column) -> Column:
    """``toFixed(2)`` on a decimal amount: a decimal(18,2) prints in plain
    notation with exactly two places."""
    return amount.cast(MONEY_SQL).cast("string")


def build_breakdown(long_df: DataFrame, keys: list[str], key_col: str = "clave",
                    declared_col: str = "declarado", delivered_col: str = "entregado",
                    out_col: str = "desglose_bancos") -> DataFrame:
    """Long (keys, bank key, declared, delivered) -> breakdown text per group.

    Every declared entry is printed; only deliveries > 0 are printed, and
    the delivery part is present only when one is."""
    order = F.struct(
        F.when(F.col(key_col).rlike(r"^[0-9]+$"), F.lit(0)).otherwise(F.lit(1)).alias("o1"),
        F.col(key_col).try_cast("long").alias("o2"), F.col(key_col).alias("o3"))
    dec = F.concat(F.col(key_col), F.lit(": L "), money_text(F.col(declared_col)))
    dlv = F.when(F.col(delivered_col) > 0,
                 F.concat(F.col(key_col), F.lit(": L "), money_text(F.col(delivered_col))))
    g = long_df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col(declared_col).isNotNull(),
                                           F.struct(order.alias("o"), dec.alias("t"))))).alias("_d"),
        F.array_sort(F.collect_list(F.when(dlv.isNotNull(), F.struct(order.alias("o"), dlv.alias("t")))))
         .alias("_e"))
    dec_text = F.array_join(F.transform("_d", lambda e: e["t"]), " | ")
    dlv_text = F.array_join(F.transform("_e", lambda e: e["t"]), " / ")
    text = F.when(F.size("_e") > 0, F.concat(dec_text, F.lit(" || ENTREGA: "), dlv_text)).otherwise(dec_text)
    return g.select(*keys, text.alias(out_col))
