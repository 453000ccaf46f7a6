import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_has_a_name_and_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def test_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "inodelake"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "inodelake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'frag_stats' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
