import subprocess
import sys
from pathlib import Path


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["stt", "edt", "province_id", "province_name", "order_count", "order_amount"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_text_operators(tmp_path):
    """The entry works where those operators and their pipeline have been taken away."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) == 30, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
