"""Nothing outside of the optional subpackage needs it; no job depends on one executor."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SOURCES = [p for p in (ROOT / "emberline").rglob("*.py") if "llm" not in p.parts]


def test_core_never_imports_the_subpackage():
    for p in SOURCES:
        assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_entry_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['emberline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_no_local_checkpoints_or_cross_joins():
    for p in (ROOT / "emberline").rglob("*.py"):
        assert not re.search(r"localCheckpoint\(|crossJoin\(|\.checkpoint\(|\.cache\(\)|\.persist\(", p.read_text()), p
