"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import pytest

from galacov.plans import registry
from tests.conftest import same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).limit(1).count() == 1


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports and lists the other queries when the training-data operations are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "galacov", tmp_path / "galacov", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pair_counts' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
