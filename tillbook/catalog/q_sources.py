"""A1: full scans of every derived ledger table (schema and content)."""

from __future__ import annotations

from tillbook.catalog import register
from tillbook.sources.store import StoredLedger as Ledger
from tillbook.sources.schemas import LEDGER_SCHEMAS

for _t in LEDGER_SCHEMAS:
    def _q(spark, sf_dir, _t=_t):
        return Ledger(spark, sf_dir)[_t]
    register(f"a1_load_{_t}", f"SELECT * FROM {_t}")(_q)
