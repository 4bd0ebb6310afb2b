"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names and an order-insensitive value digest)."""

import decimal

import duckdb
import pytest

from tests.conftest import SF_DIR

import __spark_entry__ as E
from tillbook import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return c


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
                   "date": "DATE", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    types = {r[0]: r[1] for r in con.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert SPARK_TO_DUCKDB.get(t, t.upper()) == types[f.name], (f.name, t, types[f.name])
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_every_query_has_oracle_or_is_streaming():
    missing = [n for n in QUERIES if n not in ORACLES and not n.startswith("j")]
    assert missing == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "total_banco" in df.columns
