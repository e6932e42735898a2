"""Delimited, JSON and fixed-width sources with explicit schemas, and the sinks that go with them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("cids", T.ArrayType(T.StringType()))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, empty_is_null: bool = True) -> DataFrame:
    """A delimited table with a header; columns by position, no inference. ``empty_is_null`` false keeps ``""``."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader if empty_is_null else reader.option("nullValue", "\x00").option("emptyValue", "")).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A delimited table with the columns in the given order; others are dropped, missing ones are NULL."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*have).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def migrate_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both under the union of their columns; what a side lacks is NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational source, read only; with ``partition`` (column, low, high, number) by parallel ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if partition:
        c, lo, hi, n = partition
        r = r.option("partitionColumn", c).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", n)
    return r.load()


def read_sqlite(spark: SparkSession, path: str, query: str, schema: T.StructType, split_on: str, partitions: int = 8) -> DataFrame:
    """A read-only scan of a SQLite file on the driver, which is sent to every worker, in ``partitions`` slices of a whole-number column.

    A row with a NULL in that column is in the first slice.
    """
    import os

    names = schema.fieldNames()
    spark.sparkContext.addFile(path)
    held = os.path.basename(path)

    def scan(batches):
        import sqlite3

        import pandas as pd
        from pyspark import SparkFiles

        con = sqlite3.connect(f"file:{SparkFiles.get(held)}?mode=ro", uri=True)
        try:
            for slices in batches:
                for i in slices["id"]:
                    part = f"SELECT * FROM ({query}) WHERE coalesce(abs({split_on}) % {partitions}, 0) = {int(i)}"
                    for rows in iter(lambda c=con.execute(part): c.fetchmany(10_000), []):
                        yield pd.DataFrame(rows, columns=names)
        finally:
            con.close()

    return spark.range(0, partitions, 1, partitions).mapInPandas(scan, schema)


def name_records(lines: Column) -> Column:
    """A cached name record parsed from its JSON; NULL where it cannot be read."""
    return F.from_json(lines, NAME_RECORD)


def match_type(status: Column, ids: Column) -> Column:
    """no_match, exact_match or multiple_matches by status and number of ids; NULL status counts by its ids, errors are fetch_error."""
    n = F.coalesce(F.greatest(F.size(ids), F.lit(0)), F.lit(0))
    return F.when(status >= 500, "fetch_error").when((status == 404) | (n == 0), "no_match").when(n == 1, "exact_match").otherwise("multiple_matches")


def pdb_atoms(lines: DataFrame, text: str = "value") -> DataFrame:
    """Atom records of fixed-width structure files by column offsets; other lines are dropped, unreadable numbers are NULL."""
    cut = lambda a, b: F.trim(F.substring(text, a, b - a + 1))
    num = lambda a, b, k: F.expr(f"try_cast(trim(substring({text}, {a}, {b - a + 1})) AS {k})")
    kept = lines.filter(F.substring(text, 1, 6).isin("ATOM  ", "HETATM"))
    rest = [c for c in lines.columns if c != text]
    return kept.select(*rest, cut(1, 6).alias("record"), num(7, 11, "int").alias("serial"), cut(13, 16).alias("atom"), cut(17, 17).alias("altloc"), cut(18, 20).alias("residue"), cut(22, 22).alias("chain"), num(23, 26, "int").alias("residue_no"), num(31, 38, "double").alias("x"), num(39, 46, "double").alias("y"), num(47, 54, "double").alias("z"), cut(78, 79).alias("atom_type"))


def pose_models(lines: DataFrame, file: str, number: str, text: str = "value") -> DataFrame:
    """Adds ``model``: the running number of ``MODEL`` lines inside a file, in line order; 0 before the first."""
    from pyspark.sql import Window as W

    w = W.partitionBy(file).orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("model", F.sum(F.when(F.col(text).startswith("MODEL"), 1).otherwise(0)).over(w))


def markdown(df: DataFrame, title: str, order: str) -> DataFrame:
    """A table as the lines of a Markdown report: ``line_no`` and ``text``, the rows along a unique ``order``. NULL is empty, bars are escaped."""
    from ..operators.identity import with_row_id

    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    rows = with_row_id(df, order, "_i").select((F.col("_i") + 3).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("text"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return df.sparkSession.createDataFrame(list(enumerate(head)), "line_no bigint, text string").unionByName(rows)


def file_hash(path: str) -> str:
    """SHA-256 of a local file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for piece in iter(lambda: f.read(1 << 20), b""):
            h.update(piece)
    return h.hexdigest()


def write_manifest(path: str, content: dict, files: Iterable[str] = ()) -> str:
    """A JSON manifest with the hashes of local files, keys sorted; returns its own hash."""
    body = json.dumps(content | {"files": {f: file_hash(f) for f in files}}, sort_keys=True, indent=1)
    with open(path, "w") as f:
        f.write(body)
    return hashlib.sha256(body.encode()).hexdigest()


def verify_manifest(path: str) -> list[str]:
    """Files that changed since the manifest or are gone, all of them."""
    bad = []
    with open(path) as f:
        for name, want in json.load(f)["files"].items():
            try:
                if file_hash(name) != want:
                    bad.append(name)
            except OSError:
                bad.append(name)
    return bad
