"""The entry without the training-data half, or without what that half needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as e
q = e.queries()
assert len(q) >= 78 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in q), sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""


def test_entry_without_libraries_or_folders():
    for hidden in (["public_tokenizers"], ["rowgauge.llm"], ["corpus_pipeline"]):
        subprocess.run([sys.executable, "-c", CODE.format(hidden=hidden)], cwd=ROOT, check=True, timeout=120)
