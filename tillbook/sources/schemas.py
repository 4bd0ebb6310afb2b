"""A2: explicit ledger schemas (no inference) and column defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_SQL = "decimal(18,2)"


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_TS = T.TimestampNTZType()
L, S = T.LongType(), T.StringType()

LEDGER_SCHEMAS: dict[str, T.StructType] = {
    "tiendas": _s(("id", L), ("nombre", S), ("efectivo_actual", MONEY)),
    "bancos": _s(("id", L), ("nombre", S), ("color", S), ("estado", S)),
    "saldos_bancarios": _s(("banco_id", L), ("saldo", MONEY), ("saldo_inicial", MONEY),
                           ("actualizado_en", _TS)),
    "comisiones": _s(("id", L), ("tipo_transaccion", S), ("banco_id", L),
                     ("valor_efectivo", MONEY), ("valor_virtual", MONEY)),
    # the password column is never part of the schema, so it is never read
    "usuarios": _s(("id", L), ("username", S), ("rol", S), ("tienda_id", L)),
    "transacciones": _s(("id", L), ("fecha_hora", _TS), ("tienda_id", L), ("banco_id", L),
                        ("usuario_id", L), ("tipo", S), ("monto_efectivo", MONEY),
                        ("monto_banco", MONEY), ("comision_efectivo", MONEY),
                        ("comision_banco", MONEY), ("referencia", S)),
    "aperturas_caja": _s(("id", L), ("tienda_id", L), ("usuario_id", L),
                         ("saldo_inicial_efectivo", MONEY), ("saldos_bancos_json", S),
                         ("fecha_hora", _TS), ("estado", S)),
    "cierres_caja": _s(("id", L), ("tienda_id", L), ("usuario_id", L), ("fecha", _TS),
                       ("saldo_teorico", MONEY), ("saldo_real", MONEY), ("diferencia", MONEY),
                       ("desglose_bancos", S), ("observaciones", S)),
    "remesas": _s(("id", L), ("tienda_id", L), ("monto", MONEY), ("fecha_envio", _TS),
                  ("estado", S), ("banco_id", L), ("fecha_recepcion", _TS),
                  ("usuario_recibe_id", L), ("observaciones", S)),
    "tesoreria_log": _s(("id", L), ("tipo", S), ("monto", MONEY), ("referencia", S),
                        ("fecha_hora", _TS), ("banco_id", L), ("banco_destino_id", L)),
    "cierres_tesoreria": _s(("id", L), ("usuario_id", L), ("fecha_hora", _TS),
                            ("saldos_json", S), ("total_efectivo", MONEY), ("observaciones", S)),
    "depositos_adelantados": _s(("id", L), ("banco_id", L), ("monto", MONEY), ("referencia", S),
                                ("fecha_hora", _TS), ("estado", S), ("fecha_pago", _TS)),
    "gastos": _s(("id", L), ("fecha_hora", _TS), ("banco_id", L), ("monto", MONEY),
                 ("categoria", S), ("descripcion", S)),
}

# Column defaults declared by the reference DDL.
DEFAULTS: dict[str, dict[str, object]] = {
    "tiendas": {"efectivo_actual": 0},
    "bancos": {"estado": "Activo"},
    "saldos_bancarios": {"saldo": 0},
    "comisiones": {"valor_efectivo": 0, "valor_virtual": 0},
    "transacciones": {"monto_efectivo": 0, "monto_banco": 0, "comision_efectivo": 0,
                      "comision_banco": 0},
    "aperturas_caja": {"estado": "Abierta"},
    "remesas": {"estado": "Pendiente"},
    "depositos_adelantados": {"estado": "Pendiente"},
}


def ledger_schemas() -> dict[str, T.StructType]:
    return dict(LEDGER_SCHEMAS)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the table schema: missing columns become NULL
    (or their default), types are cast, extra columns are dropped."""
    schema = LEDGER_SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    cols: list[Column] = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
