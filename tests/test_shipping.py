"""Queries run where the repository lies on the driver's path alone and workers start elsewhere."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from varve.session import local_session
from varve.plans import load_all
spark = local_session("elsewhere", "2", 2)
for name in ("fit4_principal_component", "mce4_upper_mcse"):
    print(name, load_all().QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_a_foreign_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(RUN)
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert int(counts["fit4_principal_component"]) > 0 and int(counts["mce4_upper_mcse"]) > 0
