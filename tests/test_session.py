import os
import shutil
import subprocess
import sys

import pytest

from quillwork import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = session.materialize(spark.range(5).selectExpr("id", "id * 2 AS x"), "test")
    path = df._quillwork_path
    assert path.startswith(session.shared_dir(spark)) and df.count() == 5
    assert "LocalTableScan" not in df._jdf.queryExecution().toString() and os.path.isdir(path.removeprefix("file://"))
    session.forget(df)
    assert not os.path.isdir(path.removeprefix("file://"))
    session.forget(df)
    session.forget(spark.range(1))


def test_materialize_keeps_an_empty_schema(spark):
    df = session.materialize(spark.createDataFrame([], "a int, b array<string>"), "empty")
    assert df.count() == 0 and df.dtypes == [("a", "int"), ("b", "array<string>")]


def test_workers_get_the_package(tmp_path, sf):
    """Python workers find the package though neither the folder nor the path holds it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from quillwork.session import get_spark
spark = get_spark(cpus=2)
from quillwork.plans.registry import core
print("rows", core()[0]["ml_09_scaffold"](spark, {sf!r}).count(), core()[0]["src_16_table_records"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows" in out.stdout, out.stderr[-2000:]


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)


def test_a_broken_subpackage_is_an_error(tmp_path):
    shutil.copytree(f"{ROOT}/quillwork", tmp_path / "quillwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "quillwork" / "llm").mkdir()
    (tmp_path / "quillwork" / "llm" / "__init__.py").write_text("")
    (tmp_path / "quillwork" / "llm" / "registry.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr
