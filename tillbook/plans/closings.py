"""Closing analytics: H7 enriched closings, H8 close a shift, H9 variance
class, H10 close preview, H14 closings report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.balances import map_total
from tillbook.functions.breakdown import breakdown_long, build_breakdown, parse_breakdown
from tillbook.functions.forms import melt_form
from tillbook.functions.money import round_cents
from tillbook.operators.aggregations import shift_by_bank, shift_by_type, shift_moved_total, shift_summary
from tillbook.operators.joins import asof_opening, enrich_closings
from tillbook.sources.schemas import MONEY_SQL, conform

# Variance labels, tolerance and generated texts.
TOLERANCE = 0.01
BALANCED, SHORT, OVER = "CUADRA", "FALTA", "SOBRA"
ADJ_OVER, ADJ_SHORT = "Sobrante", "Faltante"
ADJ_REFERENCE = "Ajuste Automático por Cierre"
REMIT_BANK_NOTE, REMIT_FUND_NOTE = "Entrega de banco", "Entrega Fondo General"


def zero() -> Column:
    return F.lit(0).cast(MONEY_SQL)


def shifts(L) -> DataFrame:
    """Shift per closing: as-of opening .. closing time."""
    return asof_opening(L["cierres_caja"], L["aperturas_caja"]).select(
        F.col("id").alias("cierre_id"), "tienda_id", "desde", F.col("fecha").alias("hasta"), "saldo_inicial_ef")


def closings_enriched(L) -> DataFrame:
    """H7: every closing (joined to store and user) with its as-of opening,
    type summary, moved total, declared and delivered totals. Its bank summary
    and maps are frames of their own: ``closings_bank_summary``,
    ``closings_maps``."""
    sh = shifts(L)
    summ = shift_moved_total(shift_summary(shift_by_type(L["transacciones"], sh), sh))
    base = parse_breakdown(enrich_closings(L["cierres_caja"], L["tiendas"], L["usuarios"]))
    base = base.select("id", "tienda_id", "tienda_nombre", "username", "fecha", "saldo_teorico", "saldo_real",
                       "diferencia", map_total(F.col("declarado")).alias("total_declarado"), "total_entregado")
    s = sh.select(F.col("cierre_id").alias("_sid"), "desde", "saldo_inicial_ef")
    return (base.join(s, base.id == s._sid, "inner").join(summ, base.id == summ.cierre_id, "left")
                .drop("_sid", "cierre_id"))


def closings_bank_summary(L) -> DataFrame:
    """H7: per closing (joined to store and user) and bank of its shift: in,
    out, net and operations."""
    c = enrich_closings(L["cierres_caja"], L["tiendas"], L["usuarios"]).select(F.col("id").alias("_cid"), "tienda_id", "fecha")
    banks = shift_by_bank(L["transacciones"], shifts(L), L["bancos"])
    return banks.join(c, banks.cierre_id == c._cid, "inner").drop("_cid")


def closings_maps(L) -> DataFrame:
    """H7: what each closing (joined to store and user) declared and delivered
    per bank key, in long form: (cierre_id, clave, declarado, entregado); an
    amount is NULL where that part does not name the key."""
    c = enrich_closings(L["cierres_caja"], L["tiendas"], L["usuarios"])
    parts = breakdown_long(c, ["id"])
    return parts.groupBy(F.col("id").alias("cierre_id"), "clave").agg(*[
        F.max(F.when(F.col("parte") == part, F.col("monto"))).cast(MONEY_SQL).alias(part) for part in ("declarado", "entregado")])


def variance_class(ci: DataFrame, delivered: Column | None = None) -> DataFrame:
    """H9: CUADRA (|d| < 0.01) / FALTA / SOBRA, the label with 2 decimals and
    the cash left for the next day max(0, real - delivered)."""
    d = F.coalesce(F.col("diferencia"), zero())
    ok = F.abs(d) < F.lit(TOLERANCE)
    clase = F.when(ok, BALANCED).when(d < 0, SHORT).otherwise(OVER)
    label = (F.when(ok, F.lit(BALANCED))
             .when(d < 0, F.concat(F.lit(SHORT + " L "), F.abs(d).cast(MONEY_SQL).cast("string")))
             .otherwise(F.concat(F.lit(OVER + " L "), d.cast(MONEY_SQL).cast("string"))))
    dl = delivered if delivered is not None else F.col("total_entregado")
    left = F.greatest(F.coalesce(F.col("saldo_real"), zero()) - F.coalesce(dl, zero()), zero())
    return ci.withColumn("clase", clase).withColumn("etiqueta", label) \
             .withColumn("queda_manana", left.cast(MONEY_SQL))


def _form_parts(forms: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, clave, declarado, entregado) from closing forms."""
    long = melt_form(forms, id_cols).filter(F.col("campo").isin("banco", "entrega_banco"))
    return long.groupBy(*id_cols, F.col("banco_key").alias("clave")).agg(
        F.sum(F.when(F.col("campo") == "banco", F.col("monto"))).alias("declarado"),
        F.sum(F.when(F.col("campo") == "entrega_banco", F.col("monto"))).alias("entregado"))


def close_shift(forms: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """H8: closing forms -> closing rows, adjustment transactions and
    remittances.

    ``forms``: (form_id, tienda_id, ts, form map); ``expected``: (form_id,
    saldo_teorico), the store cash just before each form (I17 computes it
    from the postings fold). ``cierres``: the closing rows as the table
    ``cierres_caja`` has them, with the user and the note (form field
    ``observaciones``) where forms have them."""
    parts = _form_parts(forms, ["form_id"])
    tot = parts.groupBy("form_id").agg(
        F.coalesce(F.sum("declarado"), F.lit(0)).cast(MONEY_SQL).alias("saldo_real"),
        F.coalesce(F.sum("entregado"), F.lit(0)).cast(MONEY_SQL).alias("total_entrega"))
    text = build_breakdown(parts, ["form_id"])
    f = forms.select("form_id", "tienda_id", "ts")
    c = (f.join(tot, "form_id", "left").join(text, "form_id", "left").join(expected, "form_id", "left"))
    real = F.coalesce("saldo_real", zero())
    teo = F.coalesce("saldo_teorico", zero())
    closings = c.select("form_id", "tienda_id", F.col("ts").alias("fecha"), teo.alias("saldo_teorico"),
                        real.alias("saldo_real"), (real - teo).cast(MONEY_SQL).alias("diferencia"),
                        F.coalesce("desglose_bancos", F.lit("")).alias("desglose_bancos"),
                        F.greatest(real - F.coalesce("total_entrega", zero()), zero()).cast(MONEY_SQL)
                         .alias("saldo_final"))
    d = F.col("diferencia")
    adjustments = closings.filter(F.abs(d) >= F.lit(TOLERANCE)).select(
        "form_id", "tienda_id", F.lit(None).cast("long").alias("banco_id"),
        F.when(d > 0, ADJ_OVER).otherwise(ADJ_SHORT).alias("tipo"), d.alias("monto_efectivo"),
        zero().alias("monto_banco"), F.lit(ADJ_REFERENCE).alias("referencia"), F.col("fecha").alias("fecha_hora"))
    bank = F.when(F.col("clave") == "Otros", F.lit(None).cast("long")).otherwise(F.col("clave").try_cast("long"))
    rem = parts.filter(F.col("entregado") > 0).join(f, "form_id").select(
        "form_id", "tienda_id", F.col("entregado").cast(MONEY_SQL).alias("monto"), F.col("ts").alias("fecha_envio"),
        F.lit("Pendiente").alias("estado"), bank.alias("banco_id"),
        F.when(bank.isNotNull(), REMIT_BANK_NOTE).otherwise(REMIT_FUND_NOTE).alias("observaciones"))
    user = (F.col("usuario_id") if "usuario_id" in forms.columns else F.lit(None)).cast("long").alias("usuario_id")
    head = forms.select(F.col("form_id").alias("id"), user, F.try_element_at(F.col("form"), F.lit("observaciones")).alias("observaciones"))
    rows = closings.withColumnRenamed("form_id", "id").join(head, "id", "left")
    return {"closings": closings, "adjustments": adjustments, "remittances": rem, "cierres": conform(rows, "cierres_caja")}


def close_preview(forms: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Preview of a closing form: per bank the remainder max(0, declared
    - delivered) (form values cleaned to digits and dot, cents rounded half
    up), totals, rounded difference vs expected, state, final cash."""
    long = forms.select("form_id", F.explode("form").alias("k", "v"))
    kind = (F.when(F.col("k").startswith("entrega_banco_"), "entregado")
            .when(F.col("k").startswith("banco_"), "declarado"))
    key = F.regexp_replace(F.col("k"), "^(entrega_)?banco_", "")
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("v", F.lit("")), ",", ""), r"[^\d.]", "")
    val = F.coalesce(round_cents(F.regexp_extract(clean, r"^([0-9]+[.]?[0-9]*|[.][0-9]+)", 0)
                                 .try_cast("decimal(20,4)")), zero())
    vals = long.select("form_id", kind.alias("parte"), key.alias("clave"), val.alias("monto")) \
               .filter(F.col("parte").isNotNull())
    per_bank = vals.groupBy("form_id", "clave").agg(
        F.coalesce(F.sum(F.when(F.col("parte") == "declarado", F.col("monto"))), F.lit(0)).cast(MONEY_SQL)
         .alias("declarado"),
        F.coalesce(F.sum(F.when(F.col("parte") == "entregado", F.col("monto"))), F.lit(0)).cast(MONEY_SQL)
         .alias("entregado"))
    per_bank = per_bank.withColumn("resto", F.greatest(F.col("declarado") - F.col("entregado"), zero())
                                   .cast(MONEY_SQL))
    shown = per_bank.filter((F.col("resto") > 0) | (F.col("declarado") > 0))
    tot = per_bank.groupBy("form_id").agg(round_cents(F.sum("declarado")).alias("total_declarado"),
                                          round_cents(F.sum("entregado")).alias("total_entrega"))
    t = tot.join(expected, "form_id", "left")
    diff = round_cents(F.col("total_declarado") - F.coalesce("saldo_teorico", zero()))
    t = t.withColumn("diferencia", diff).withColumn(
        "estado", F.when(F.abs(F.col("diferencia")) < F.lit(TOLERANCE), BALANCED)
                   .when(F.col("diferencia") < 0, SHORT).otherwise(OVER)) \
         .withColumn("saldo_final", F.greatest(F.col("total_declarado") - F.col("total_entrega"), zero())
                     .cast(MONEY_SQL))
    return {"per_bank": shown, "totals": t}


def closings_report(L) -> DataFrame:
    """Consolidated closings with store and user names and the signed
    difference text, newest first."""
    c = enrich_closings(L["cierres_caja"], L["tiendas"], L["usuarios"])
    d = F.coalesce(F.col("diferencia"), zero())
    signed = F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), d.cast(MONEY_SQL).cast("string"))
    return c.withColumn("diferencia_texto", signed).orderBy(F.col("fecha").desc(), F.col("id").desc())
