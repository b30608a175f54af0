"""The engine without the corpus subpackage: everything else imports and runs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'symbol_map' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("corpus_pipeline.py", "graphloom/llm/__pycache__/registry.cpython-313.pyc")])
def test_import_without_corpus_operators(tmp_path, left):
    shutil.copytree(ROOT, tmp_path / "tree", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm")])
    if "corpus_pipeline.py" not in left and (tmp_path / "tree/corpus_pipeline.py").exists():
        os.remove(tmp_path / "tree/corpus_pipeline.py")
    for name in left[1:]:
        os.makedirs(os.path.dirname(tmp_path / "tree" / name))
        (tmp_path / "tree" / name).write_bytes(b"")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path / "tree", env=env, check=True, timeout=120)


def test_broken_operators_are_no_missing_ones(tmp_path):
    if not os.path.exists(f"{ROOT}/graphloom/llm/registry.py"):
        pytest.skip("no corpus operators here")
    shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    os.remove(tmp_path / "tree/graphloom/llm/kernels.py")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "tree", capture_output=True, timeout=120)
    assert done.returncode
