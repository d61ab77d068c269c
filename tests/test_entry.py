"""The entry module where a library of the corpus operators is missing."""

import subprocess
import sys

from conftest import ROOT


def test_library_queries_without_xxhash():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sharpen' in q and 'sharpen' in e.oracle_sql() and not [k for k in q if k[:2] == 'op' or k == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_library_needs_no_corpus_operators():
    code = "import sys; import rastrum.plans.queries, rastrum.streaming.files; assert not [m for m in sys.modules if m.startswith('rastrum.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
