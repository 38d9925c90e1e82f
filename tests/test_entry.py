import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_before_a_session_exists():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_reads_a_table(spark, tmp_path):
    """On a folder that has no tables none may return: each reads what it is given."""
    read = []
    for name, query in __spark_entry__.queries().items():
        try:
            query(spark, str(tmp_path / "none")).schema  # noqa: B018
            read.append(name)
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e) or "No such file" in str(e), (name, str(e)[:300])
    assert read == []
