from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

REPO = Path(contract.__file__).parent


def test_contract(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    found = contract.entry(spark)
    assert found.columns == ["query_id", "item_id", "rank", "distance"] and found.count() > 0


def test_the_core_stands_alone():
    """Without the subpackage of training data the rest imports and keeps its queries."""
    code = "import sys; sys.modules['vecloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and 'p5_found' in q and 'p1_found' not in q"
    ran = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    for path in (REPO / "vecloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "vecloom.llm" not in path.read_text()
