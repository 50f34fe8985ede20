"""The entry module without the optional folders."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_everything_else_works_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['veritally.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries()); assert 'full_report' in names and 'pipeline' not in names\n"
        "assert not any(n.startswith('op') for n in names) and set(e.oracle_sql()) == names; print(len(names))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) >= 73
