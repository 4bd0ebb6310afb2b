"""Group C: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.text import classify_type as _classify
from tillbook.functions.timeparse import business_day
from tillbook.operators.joins import enrich_tx
from tillbook.sources.schemas import MONEY_SQL


def transactions_listing(tx: DataFrame, tiendas: DataFrame, bancos: DataFrame, usuarios: DataFrame,
                         tipo: str | None = None, tienda: int | None = None) -> DataFrame:
    """Enriched listing with optional equality filters, newest first.
    Filters are applied to the fact side before the joins (pushed to the scan)."""
    t = tx
    if tienda is not None:
        t = t.filter(F.col("tienda_id") == F.lit(tienda))
    if tipo is not None:
        t = t.filter(F.col("tipo") == F.lit(tipo))
    return enrich_tx(t, tiendas, bancos, usuarios).orderBy(F.col("fecha_hora").desc(), F.col("id").desc())


def text_filter(df: DataFrame, store: str | None, bank: str | None, day: str | None,
                ts_col: str = "fecha_hora", tz: str | None = None) -> DataFrame:
    """Case-insensitive substring on store and bank names + exact day."""
    out = df
    if store:
        out = out.filter(F.lower(F.coalesce("tienda_nombre", F.lit(""))).contains(store.lower()))
    if bank:
        out = out.filter(F.lower(F.coalesce("banco_nombre", F.lit(""))).contains(bank.lower()))
    if day:
        out = out.filter(business_day(ts_col, tz) == F.lit(day).cast("date"))
    return out


def scope_to_role(df: DataFrame, rol: str, tienda_id: int | None) -> DataFrame:
    """A cashier sees their own store only; other roles see all."""
    if rol == "Cajero":
        return df.filter(F.col("tienda_id") == F.lit(tienda_id))
    return df


def distinct_types(tx: DataFrame) -> DataFrame:
    """C4: sorted distinct transaction types."""
    return tx.select("tipo").distinct().orderBy("tipo")


def classify_type(tx: DataFrame) -> DataFrame:
    """Adds the display class of the type."""
    return tx.withColumn("clase", _classify(F.col("tipo")))


def open_tills(ap: DataFrame) -> DataFrame:
    """Openings still open."""
    return ap.filter(F.col("estado") == "Abierta")


def pending_remits(rem: DataFrame) -> DataFrame:
    """Remittances not yet received."""
    return rem.filter(F.col("estado") == "Pendiente")


def pending_debts(dep: DataFrame) -> DataFrame:
    """Advance deposits not yet paid."""
    return dep.filter(F.col("estado") == "Pendiente")


# History buckets by transaction label.
HISTORY_BUCKETS = {
    "ingresos": ["Remesa Recibida", "Traslado (Efectivo)"],
    "salidas": ["Gasto Bancario", "Entrega Dueño", "Envío a Tienda", "Pago Depósito Adelantado",
                "Depósito a Banco"],
    "ajustes": ["Ajuste de Cuadre", "Traslado (Solo Saldo)"],
}


def bucket_history(hist: DataFrame) -> DataFrame:
    """History rows into ingresos / salidas / ajustes; other types drop."""
    b = None
    for name, types in HISTORY_BUCKETS.items():
        cond = F.col("tipo_trans").isin(types)
        b = F.when(cond, F.lit(name)) if b is None else b.when(cond, F.lit(name))
    return hist.withColumn("grupo", b).filter(F.col("grupo").isNotNull())


def split_valid(cmds: DataFrame, amount: str = "monto", source: str | None = None,
                target: str | None = None, required: list[str] | None = None):
    """(valid, rejected). Reasons, first that applies: amount not a number
    or <= 0; a required key missing; source equals target (null-safe)."""
    reason = F.when(F.col(amount).isNull() | F.isnan(F.col(amount).cast("double")) | (F.col(amount) <= 0),
                    F.lit("monto_invalido"))
    for r in required or []:
        reason = reason.when(F.col(r).isNull(), F.lit(f"falta_{r}"))
    if source and target:
        reason = reason.when(F.col(source).eqNullSafe(F.col(target)), F.lit("mismo_origen_destino"))
    tagged = cmds.withColumn("motivo", reason)
    return tagged.filter(F.col("motivo").isNull()).drop("motivo"), tagged.filter(F.col("motivo").isNotNull())


def recover_principal(tx: DataFrame) -> DataFrame:
    """Amount before commission, ``abs(abs(cash) - abs(commission))``."""
    p = F.abs(F.abs("monto_efectivo") - F.abs(F.coalesce("comision_efectivo", F.lit(0))))
    return tx.withColumn("monto_original", p.cast(MONEY_SQL))


def visible_refs(refs: DataFrame) -> DataFrame:
    """Bank reference rows with a nonzero expected or opening amount."""
    return refs.filter((F.col("total_esperado") != 0) | (F.col("inicial") != 0))


def cashiers_without_opening(usuarios: DataFrame, ap: DataFrame, day, tz: str | None = None) -> DataFrame:
    """C11: cashiers with no open till on the business day ``day`` (a date text
    or Column), as a left anti join. ``tz``: zone of the business day where
    times are stored as UTC instants; None: they are local already."""
    d = F.lit(day).cast("date") if isinstance(day, str) else day
    open_today = ap.filter((F.col("estado") == "Abierta")
                           & (business_day("fecha_hora", tz) == d)) \
                   .select(F.col("usuario_id").alias("_u"))
    cajeros = usuarios.filter(F.col("rol") == "Cajero")
    return cajeros.join(open_today, cajeros.id == open_today._u, "left_anti")
