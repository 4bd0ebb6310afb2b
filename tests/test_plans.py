"""Plan shape checks: no query pairs rows (cartesian / nested-loop joins),
no query leaves the JVM (Python UDF evaluation), and scans are pruned."""

import contextlib
import io
import re

import pytest

from tests.conftest import SF_DIR

from tillbook import catalog
from tillbook.plans.audit import audit_matrix, audit_matrix_wide, initial_config_map, store_reference
from tillbook.sources.schemas import LEDGER_SCHEMAS

QUERIES = {n: f for n, f in catalog.queries().items() if not n.startswith("j")}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython", plan), name


def test_projection_reaches_scan(spark):
    plan = _plan(QUERIES["e4_net_since_opening"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(s.count(":") <= 6 for s in schemas)


def test_no_job_while_planning(spark, ledger):
    """The store x bank grid is lazy: plans are built without running a job."""
    tables = {n: ledger[n] for n in LEDGER_SCHEMAS}
    spark.sparkContext.setJobGroup("planning", "plans only")
    try:
        audit_matrix(tables), audit_matrix_wide(tables, [0, 1]), store_reference(tables), initial_config_map(tables)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


@pytest.mark.parametrize("name", ["e4_net_since_opening", "h1_audit_matrix", "h2_store_reference", "h5_suggested_opening"])
def test_facts_are_scanned_once_from_the_openings_on(spark, name):
    """The transactions are read by one scan (or a reused one), and the
    earliest latest opening is among the filters pushed to it."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SF_DIR).explain("formatted")
    scans = [s for s in re.split(r"\n\(\d+\) ", buf.getvalue()) if s.startswith("Scan parquet") and "/transacciones]" in s]
    assert len(scans) == 1
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(fecha_hora,\s*ScalarSubquery", scans[0])
