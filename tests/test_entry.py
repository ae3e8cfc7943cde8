"""The driver's entry with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), [n for n in q if n[:2] == 'op' and n[2].isdigit()])"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split(" ", 1)


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "hopledger", tmp_path / "hopledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    count, rest = listed(tmp_path)
    assert int(count) > 100 and rest.strip() == "[] []"
    if (tmp_path / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").unlink()
        assert listed(tmp_path) == [count, rest]


def test_other_import_errors_are_raised(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    shutil.copytree(ROOT / "hopledger", tmp_path / "hopledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
