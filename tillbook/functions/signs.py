"""Sign tables of the posting rules (cash leg, bank leg, commission)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.sources.schemas import MONEY_SQL

# Fixed values: (cash sign, bank sign, commission applies) per transaction
# type, for a new transaction and for an edited one.
POST_RULES = {
    "Depósito": (1, -1, True),
    "Retiro": (-1, 1, True),
    "Depósito Cuenta": (-1, 1, True),
    "Efectivo Entregado": (-1, 0, False),
}
EDIT_RULES = {
    "Depósito": (1, -1, True),
    "Pago Caja Empresarial": (1, -1, True),
    "Retiro": (-1, 1, True),
    "Pago Servicio": (1, -1, True),
    "Depósito Cuenta": (-1, 1, True),
    "Gasto": (0, -1, False),
}


def signed_legs(tipo: Column, monto: Column, com_ef: Column, com_vi: Column,
                rules: dict[str, tuple[int, int, bool]]) -> tuple[Column, Column]:
    """(cash amount, bank amount) of a transaction; unknown types give 0, 0."""
    zero = F.lit(0).cast(MONEY_SQL)
    cash = None
    bank = None
    for name, (cs, bs, with_com) in rules.items():
        c = monto * F.lit(cs) + (com_ef if with_com else zero)
        b = monto * F.lit(bs) + (com_vi if with_com else zero)
        cond = tipo == F.lit(name)
        cash = F.when(cond, c) if cash is None else cash.when(cond, c)
        bank = F.when(cond, b) if bank is None else bank.when(cond, b)
    return cash.otherwise(zero).cast(MONEY_SQL), bank.otherwise(zero).cast(MONEY_SQL)
