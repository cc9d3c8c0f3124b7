"""The rest of the repository without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "zephyrframe", tmp_path / "zephyrframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
    assert said.returncode == 0, said.stderr
    assert min(map(int, said.stdout.split())) > 50


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "zephyrframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "zephyrframe.llm" not in path.read_text(encoding="utf-8"), path
