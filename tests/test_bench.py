"""bench.py runs end to end and prints one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SMOKE_DIR


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMOKE_DIR, BENCH_RUNS="1", BENCH_CPUS="4", LASTMILE_DRIVER_MEMORY="4g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=900, cwd=ROOT)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.startswith("{")]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["metric"] and rec["unit"] == "sec" and rec["sf"] == 0.001
    assert len(rec["queries"]) == 9 and rec["value"] > 0
    assert abs(sum(rec["queries"].values()) - rec["value"]) < 0.01
