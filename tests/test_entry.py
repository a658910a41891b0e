"""What the driver's entry registers where parts of the repository are absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone, operators, pipeline", [((), True, True), (("corpus_pipeline.py",), True, False), (("facetgraph/llm", "tests/llm"), False, False), (("corpus_pipeline.py", "facetgraph/llm", "tests/llm"), False, False)])
def test_absent_parts_take_only_their_own_queries(tmp_path, gone, operators, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests"))
    present = (copy / "facetgraph/llm").exists() and (copy / "corpus_pipeline.py").exists()
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[3] == "True"
    if present:
        assert (int(out[1]) == 13) == operators and (int(out[1]) == 0) != operators and (out[2] == "True") == pipeline


def test_other_import_errors_are_raised(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    if (copy / "facetgraph/llm").exists():
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True)
        assert out.returncode and "no_such_module_at_all" in out.stderr


def test_a_pipeline_elsewhere_on_the_path_is_not_registered(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests"))
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    (elsewhere / "corpus_pipeline.py").write_text("ORACLE_SQL = None\n\n\ndef run(spark, sf_dir):\n    raise AssertionError\n")
    code = "import __spark_entry__ as e; print('pipeline' in e.queries(), len(e.queries()) > 100)"
    env = {**os.environ, "PYTHONPATH": str(elsewhere)}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split() == ["False", "True"]
