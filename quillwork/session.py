"""Session factory and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quillwork", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings every operator here relies on (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of this process (``local[...]``,
    as in tests) gets a temporary folder; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(path: str) -> None:
    """Delete a table written by ``materialize``; unknown paths are ignored."""
    spark = _live.pop(path, None)
    if spark is not None:
        try:
            _delete(spark, path)
        except Exception:
            pass  # the session has ended; the folder's owner cleans up


@atexit.register
def _release_all() -> None:
    for path in list(_live):
        release(path)


def reserve(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quillwork/{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` go to the writer.

    It cuts the lineage durably (a lost executor loses nothing), gives the optimizer real
    sizes, and keeps column pruning for what follows.
    """
    spark = df.sparkSession
    ship(spark)
    path = reserve(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillwork_path = path
    return out


def read_parquet(path: str, columns: list[str]):
    """One file of a materialized table as an Arrow table, read where it is called: on a worker, without a shuffle.

    Any file system that Arrow knows (local or mounted folders, HDFS, S3, GCS, Azure), by the URI Spark gives.
    """
    import pyarrow.fs
    import pyarrow.parquet

    system, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", path)))
    return pyarrow.parquet.read_table(at, columns=columns, filesystem=system)


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``materialize`` returned."""
    path = getattr(df, "_quillwork_path", None)
    if path:
        release(path)
