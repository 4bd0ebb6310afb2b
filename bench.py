"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully materialised (a no-op write of all rows) so every
operator runs; the value is the sum of the per-query wall times plus the
one-off build of the stored ledger tables (``ledger_build``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillbook import catalog  # noqa: E402
from tillbook.session import build_session  # noqa: E402
from tillbook.sources.store import build_ledger  # noqa: E402

HEADLINE = [
    "h1_audit_matrix", "h2_store_reference", "h4_treasury_balances", "h5_suggested_opening",
    "h7_closings_enriched", "h8_close_shift", "e4_net_since_opening", "e10_shift_summary",
    "e17_treasury_full_balance", "d11_asof_opening", "d12_tx_in_shift", "f5_running_store_cash",
    "f6_running_bank_balance", "g1_treasury_history", "d3_enrich_tx", "i1_post_transactions",
]


def run(spark, fn, sf_dir):
    df = fn(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")), app="tillbook-bench")
    qs = catalog.queries()
    names = [n for n in names if n in qs]
    times = {}
    # the ledger tables are derived from the driver tables and stored once
    # (timed, and counted in the total); the queries then read them
    t0 = time.perf_counter()
    build_ledger(spark, sf_dir)
    times["ledger_build"] = round(time.perf_counter() - t0, 3)
    # warm-up: codegen caches and file listing, not timed
    run(spark, qs["e4_net_since_opening"], sf_dir)
    for n in names:
        t0 = time.perf_counter()
        run(spark, qs[n], sf_dir)
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
