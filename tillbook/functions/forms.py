"""B2 melt_form: wide form bodies (map<string,string>) to long rows.

Field names carry the keys: ``monto_efectivo_<store>``,
``monto_banco_<store>_<bank>``, ``banco_<bank>``, ``entrega_banco_<bank>``
(tested before ``banco_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.money import money_or_zero

# Form field prefixes, tested in this order.
FORM_FIELDS = [
    ("monto_efectivo", r"^monto_efectivo_(.+)$", "strict"),
    ("monto_banco", r"^monto_banco_([^_]+)_(.+)$", "strict"),
    ("entrega_banco", r"^entrega_banco_(.+)$", "commas"),
    ("banco", r"^banco_(.+)$", "commas"),
]


def melt_form(df: DataFrame, id_cols: list[str], map_col: str = "form") -> DataFrame:
    """(ids, form map) -> (ids, campo, tienda_key, banco_key, monto).

    Unknown fields are dropped. Map keys are unique, so "last value wins"
    already holds for one key."""
    e = df.select(*id_cols, F.explode(F.col(map_col)).alias("_k", "_v"))
    kind = None
    store = None
    bank = None
    amount = None
    for name, pattern, mode in FORM_FIELDS:
        hit = F.col("_k").rlike(pattern)
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
        if name == "monto_efectivo":
            s, b = F.regexp_extract("_k", pattern, 1), F.lit(None).cast("string")
        elif name == "monto_banco":
            s, b = F.regexp_extract("_k", pattern, 1), F.regexp_extract("_k", pattern, 2)
        else:
            s, b = F.lit(None).cast("string"), F.regexp_extract("_k", pattern, 1)
        store = F.when(hit, s) if store is None else store.when(hit, s)
        bank = F.when(hit, b) if bank is None else bank.when(hit, b)
        a = money_or_zero(F.coalesce(F.col("_v"), F.lit("0")), mode)
        amount = F.when(hit, a) if amount is None else amount.when(hit, a)
    out = e.select(*id_cols, kind.alias("campo"), store.alias("tienda_key"),
                   bank.alias("banco_key"), amount.alias("monto"))
    return out.filter(F.col("campo").isNotNull())
