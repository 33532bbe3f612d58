"""The registry: it can be read before any session, and every query reads given tables."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session():
    code = "from tessera import catalog; q, o = catalog.queries(), catalog.oracle_sql(); assert len(q) > 100 and not set(o) - set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True).returncode == 0
