"""The rest of the library without the optional subpackage, whichever of its files are left."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left", [("corpus_pipeline.py",), ()])
def test_entry_imports_without_the_optional_subpackage(tmp_path, left):
    def unwanted(folder, names):
        return [n for n in names if n in (".git", "__pycache__", "llm", ".pytest_cache")]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=unwanted)
    for name in ("corpus_pipeline.py",):
        if name not in left:
            (copy / name).unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-B", "-c", SHOWN], cwd=copy, capture_output=True, text=True, check=True)
    names = out.stdout.split()
    assert "dash_category_trends" in names
    assert not [n for n in names if n == "pipeline" or n.startswith("op")]
    for tool in ("bench.py", "tools/verify.py"):
        code = f"import runpy; runpy.run_path({tool!r}, run_name='imported')"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, check=True)
