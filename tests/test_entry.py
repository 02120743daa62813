"""The entry module works with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_llm():
    code = (
        "import sys; sys.modules['talentgrid.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True)


def test_oracles_have_queries():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True)
