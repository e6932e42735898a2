"""Every core query against its SQL, or at least run whole."""

import pytest

from quillwork.plans.registry import core

from .compare import check, connect

QUERIES, SQL = core()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        check(df, con, SQL[name])
    else:
        assert df.count() >= 0
        assert all(kind != "void" for _, kind in df.dtypes)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_optional_subpackage_is_not_needed(tmp_path, sf):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillwork", tmp_path / "quillwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", f"import __spark_entry__ as e; from quillwork.session import get_spark; q = e.queries(); assert 'p1_found' in q and 'p4_found' not in q; assert q['p1_found'](get_spark(cpus=2), {sf!r}).count() > 0"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
