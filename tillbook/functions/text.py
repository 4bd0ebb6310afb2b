"""B8 compose_description and C5 classify_type (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def compose_description(categoria: Column | str, descripcion: Column | str,
                        default: str | None = None) -> Column:
    """``descripcion ? `${categoria} - ${descripcion}` : categoria``; an empty
    result falls back to ``default`` when given."""
    cat, desc = _c(categoria), _c(descripcion)
    has_desc = desc.isNotNull() & (desc != "")
    cat_text = F.coalesce(cat, F.lit("undefined"))
    out = F.when(has_desc, F.concat(cat_text, F.lit(" - "), desc)).otherwise(cat)
    if default is not None:
        out = F.coalesce(F.nullif(out, F.lit("")), F.lit(default))
    return out


# Transaction type classes, rules applied in this order.
TYPE_CLASS_RULES = [
    ("type-ingreso", ["Ingreso", "Sobrante"], ["Resurtido", "Traspaso Entrada"]),
    ("type-retiro", ["Retiro", "Faltante"], ["Traspaso Salida"]),
    ("type-pago", ["Pago Servicio"], []),
    ("type-gasto", [], ["Gasto"]),
]
TYPE_CLASS_DEFAULT = "type-deposito"


def classify_type(tipo: Column | str) -> Column:
    """Transaction type -> display class (exact names, then substrings)."""
    t = _c(tipo)
    expr = None
    for cls, exact, contains in TYPE_CLASS_RULES:
        cond = F.lit(False)
        for e in exact:
            cond = cond | (t == e)
        for s in contains:
            cond = cond | t.contains(s)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return expr.otherwise(F.lit(TYPE_CLASS_DEFAULT))
