"""The operators' Python runs where the workers have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from tallyframe.session import build_session
spark = build_session("workers", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
for key in ("op1_packing", "op2_fingerprint", "op3_language", "op6_simhash", "op8_quality", "op11_fill_in_middle", "op12_filter_audit", "op13_byte_bpe"):
    assert entry.queries()[key](spark, "/root/testdata/sf0.001").count() >= 200, key
print("DONE")
"""


def test_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert "DONE" in run.stdout, run.stderr[-3000:]
