"""The subpackage llm and the pipeline can be taken away."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "cairn").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert 'q_ranges_merge' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, check=True, timeout=120)
