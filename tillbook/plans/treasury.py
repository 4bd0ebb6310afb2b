"""Treasury analytics: H4 treasury balances and I21 treasury closing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.balances import bank_key, snapshot_json
from tillbook.functions.timeparse import ts_literal
from tillbook.operators.aggregations import mtotal0, total_by_treasury
from tillbook.operators.joins import enrich_debts, enrich_remits
from tillbook.plans.audit import treasury_cells
from tillbook.sources.schemas import MONEY_SQL

# Label of the NULL-bank treasury fund and the default note.
GENERAL_FUND = "Fondo General"
DEFAULT_CLOSING_NOTE = "Corte de Caja Central"


def treasury_balances(L, until=None) -> DataFrame:
    """H4: per bank and the Otros fund: base (last snapshot), flow since it,
    real balance = base + flow. ``en_flujo`` / ``en_saldos`` say whether the
    row is listed in the flow list / the balance list (the Otros row only
    when its flow / balance is not 0)."""
    cells = treasury_cells(L, until)
    names = L["bancos"].select(F.col("id").alias("_bid"), "nombre")
    other = F.col("banco_id").isNull()
    return cells.join(names, cells.banco_id == names._bid, "left").select(
        bank_key("banco_id").alias("banco_key"), F.when(other, GENERAL_FUND).otherwise(F.col("nombre")).alias("nombre"), "base", "flujo",
        "saldo", (~other | (F.col("flujo") != 0)).alias("en_flujo"), (~other | (F.col("saldo") != 0)).alias("en_saldos"))


def treasury_page(L, until=None) -> dict[str, DataFrame]:
    """H4 as the treasury page shows it: ``saldos`` (the balances),
    ``remesas_pendientes`` (with store and bank names), ``deudas`` (pending
    advances with their bank) and ``totales``: one row with the totals of the
    flow list and the balance list, the cash in transit (pending remittances of
    known stores) and the outstanding debt (pending advances of known banks)."""
    saldos = treasury_balances(L, until)
    remits = enrich_remits(L["remesas"].filter(F.col("estado") == "Pendiente"), L["tiendas"], L["bancos"])
    debts = enrich_debts(L["depositos_adelantados"].filter(F.col("estado") == "Pendiente"), L["bancos"])
    totals = total_by_treasury(saldos).select(
        "total_flujo", "total_real", remits.agg(mtotal0("monto")).scalar().alias("en_transito"),
        debts.agg(mtotal0("monto")).scalar().alias("deuda_total"))
    return {"saldos": saldos, "remesas_pendientes": remits, "deudas": debts, "totales": totals}


def close_treasury(L, as_of: str, usuario_id: int | None = None, note: str | None = None) -> DataFrame:
    """The new snapshot row: every bank's real balance and Otros as JSON
    as of ``as_of`` (it becomes the base of the next flow), plus the total."""
    bal = treasury_balances(L, as_of)
    js = snapshot_json(bal, [], "banco_key", "saldo")
    total = bal.agg(F.sum("saldo").cast(MONEY_SQL).alias("total_efectivo"))
    return js.select(ts_literal(as_of).alias("fecha_hora"),
                     F.lit(usuario_id).cast("long").alias("usuario_id"), "saldos_json",
                     F.lit(total.select("total_efectivo").scalar()).cast(MONEY_SQL).alias("total_efectivo"),
                     F.lit(note or DEFAULT_CLOSING_NOTE).alias("observaciones"))
