"""The optional part is used by nothing else, and its absence hurts nothing."""

import ast
import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for path in [*(ROOT / "veilwright").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts or not path.exists():
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("veilwright.llm" in n or n == "corpus_pipeline" for n in names), path


@pytest.mark.parametrize("pipeline", [True, False])
def test_whole_repository_without_it(tmp_path, pipeline):
    """A copy of everything but the optional folders: entry points work, all tests can be collected, and some are run."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    run = lambda *args: subprocess.run([sys.executable, "-B", *args], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": ""})
    run("-c", code)
    run("-m", "pytest", "-q", "-p", "no:cacheprovider", "--collect-only", "tests")
    if pipeline:
        run("-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_overlaps.py")
