"""The package works without its optional parts, and errors inside them aren't swallowed."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def copy(to: Path, *left_out: str) -> Path:
    shutil.copytree(ROOT / "lateweave", to / "lateweave", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    return to


def run(folder: Path, code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_left_out(tmp_path, left_out):
    got = run(copy(tmp_path, *left_out), NAMES)
    assert got.returncode == 0, got.stderr
    names = got.stdout.split()
    assert "fde_topk" in names and "pipeline" not in names
    if "llm" in left_out:
        assert not any(n.startswith("op") for n in names)


def test_an_error_inside_is_seen(tmp_path):
    if not (ROOT / "lateweave/llm").exists():
        pytest.skip("nothing to break")
    folder = copy(tmp_path)
    (folder / "lateweave/llm/common.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(folder, NAMES).stderr


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "lateweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lateweave").parts:
            assert "llm" not in p.read_text(encoding="utf-8"), p
