"""The entry and the library's queries must stand without the text subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

from aislewise.plans.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("without", [("aislewise/llm",), ("aislewise/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports(tmp_path, without):
    if "aislewise/llm" not in without and not os.path.isdir(f"{ROOT}/aislewise/llm"):
        pytest.skip("the text subpackage is not here")
    for name in ("aislewise", "__spark_entry__.py", "corpus_pipeline.py"):
        source = f"{ROOT}/{name}"
        skip = shutil.ignore_patterns("__pycache__", *[os.path.basename(w) for w in without])
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=skip)
        elif os.path.exists(source) and name not in without:
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    n_queries, n_oracles = map(int, out.stdout.split())
    if "aislewise/llm" in without:
        assert (n_queries, n_oracles) == (len(QUERIES), len(QUERIES))
    else:
        assert n_queries > len(QUERIES)
