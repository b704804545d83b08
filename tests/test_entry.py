"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["day", "spent_usd", "stopped"] and df.count() > 0


def test_queries_have_their_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 45


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without these folders still imports and offers the other queries."""
    (tmp_path / "noticeflow").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "noticeflow").iterdir():
        if p.name != "llm":
            (tmp_path / "noticeflow" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_daily_budget' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "noticeflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert "noticeflow.llm" not in p.read_text(), p
