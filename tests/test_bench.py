"""bench.py prints one JSON line with the agreed keys (run on sf0.001)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "e4_net_since_opening", "h1_audit_matrix"],
                         env=env, capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.startswith("{")]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == 0.001
    assert set(rec["queries"]) == {"ledger_build", "e4_net_since_opening", "h1_audit_matrix"}
    assert abs(rec["value"] - sum(rec["queries"].values())) < 0.01
