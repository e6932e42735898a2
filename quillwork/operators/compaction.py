"""Consolidating many small files into few well-sized ones.

Method: cumulative-size grouping. The manifest (one line per file) is written once and so
frozen; its files are put in order, their bytes are summed along that order, and a file
belongs to the group whose target-sized interval its first byte falls in. Planning is SQL
only. The order is (shard, path) with the shard taken from the path's MD5, so that the
running sum is a window per shard plus the offsets of at most 4,096 shards: no task ever
holds the whole manifest, and a directory that holds a third of all files is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..session import materialize, reserve

#: Bytes of a consolidated file unless the caller says otherwise.
TARGET_BYTES = 128 * 1024 * 1024

MANIFEST_SQL = """
SELECT file_path, substring(md5(file_path), 1, 3) AS shard,
       CAST(coalesce(max(file_bytes), 0) AS BIGINT) AS bytes, count(*) AS n_rows
FROM {rows} WHERE file_path IS NOT NULL GROUP BY file_path
"""

PLAN_SQL = """
SELECT m.file_path, m.bytes, m.n_rows,
       CAST(o.before + coalesce(sum(m.bytes) OVER (PARTITION BY m.shard ORDER BY m.file_path
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte,
       CAST(floor((o.before + coalesce(sum(m.bytes) OVER (PARTITION BY m.shard ORDER BY m.file_path
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / {target}) AS INT) AS group_id
FROM {manifest} m JOIN (
  SELECT shard, coalesce(sum(bytes) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT shard, sum(bytes) AS bytes FROM {manifest} GROUP BY shard)
) o ON m.shard = o.shard
"""


def manifest(rows: DataFrame) -> DataFrame:
    """One line per file: path, shard, bytes (0 where unknown) and number of rows. Rows without a path have no file."""
    return rows.sparkSession.sql(MANIFEST_SQL.format(rows="{rows}"), rows=rows)


def plan_groups(frozen: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Assign every file of a manifest to a group of about ``target_bytes``.

    ``group_id`` is the group a file's first byte falls in; a file larger than the target runs
    over the groups after it, which ``compact`` fills with its rows. An empty manifest gives
    no groups.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    return frozen.sparkSession.sql(PLAN_SQL.format(manifest="{manifest}", target=int(target_bytes)), manifest=frozen)


def record_key(rows: DataFrame) -> DataFrame:
    """Adds ``_name``, ``_status``, ``_cids``: what makes two rows the same record.

    The name counts without letter case, composition and white space differences, the ids
    as a set in which NULL equals empty and NULL members are dropped.
    """
    return rows.select(
        "*",
        name_key(F.col("name")).alias("_name"),
        F.col("status").alias("_status"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col("cids"), F.array().cast("array<string>"))))), "\x1f").alias("_cids"),
    )


@dataclass
class Compaction:
    """What ``compact`` leaves: the frozen plan, the consolidated table's path and the reconciliation."""

    plan: DataFrame
    path: str
    written: DataFrame
    report: DataFrame


def compact(rows: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None) -> Compaction:
    """Rewrite a name cache into a few files that hold each distinct record exactly once.

    Of rows that hold the same record the earliest ``written_at`` is kept (NULL is latest),
    on ties the smallest ``record_id``; rows with neither name nor status, or without
    ``record_id``, hold no record. Lines that share a ``record_id`` are one row delivered again:
    it is written once, as the earliest of them.

    A group becomes one file. A file larger than the target fills the groups its bytes run
    over, its rows dealt by hash; rows whose path is NULL, dealt alike, get as many groups of
    their own as their bytes need (a row of unknown size counts as the mean). So no group holds
    much more than the target, whatever a file or the rows without one amount to. A record that
    occurs in a third of all rows is reduced map-side to its survivor, so no task sees all its
    copies. Extra columns of ``rows`` are carried along; columns named like the
    operator's own (``_name``, ``_status``, ``_cids``, ``group_id``) are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("_name", "_status", "_cids", "group_id")
    frozen = materialize(manifest(rows), "manifest")
    plan = materialize(plan_groups(frozen, target_bytes), "plan")
    keyed = record_key(rows.filter(_holds_record()))
    keep = keyed.groupBy("_name", "_status", "_cids").agg(F.min(F.struct(F.col("written_at").isNull().alias("late"), F.col("written_at").alias("at"), F.col("record_id").alias("id"))).alias("k")).select(F.col("k.id").alias("record_id"))
    whole = plan.agg(F.max("group_id").alias("g"), F.max(_last_group(target_bytes)).alias("last"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n")).first()
    n_groups = (whole["last"] or 0) + 1 if whole["g"] is not None else 0
    mean = max(1.0, (whole["bytes"] or 0) / max(1, whole["n"] or 0))
    loose = rows.filter("file_path IS NULL").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("file_bytes").cast("double"), F.lit(mean))).alias("bytes")).first()
    n_loose = max(1, -(-int(loose["bytes"] or 0) // target_bytes)) if loose["n"] else 0
    first = F.struct(F.col("written_at").isNull().alias("late"), "written_at", "name", "status", "cids")
    # the semi-join has brought equal ids together, so picking one of their lines moves nothing
    one = rows.join(keep, "record_id", "left_semi").groupBy("record_id").agg(F.min_by(F.struct(*rows.columns), first).alias("r")).select("r.*")
    to = plan.select("file_path", "group_id", (_last_group(target_bytes) - F.col("group_id") + 1).alias("_span"))
    dealt = F.pmod(F.xxhash64("record_id"), F.coalesce("_span", F.lit(max(1, n_loose))).cast("bigint"))
    kept = one.join(to, "file_path", "left").select(*rows.columns, (F.coalesce("group_id", F.lit(n_groups)) + dealt).cast("int").alias("group_id"))
    path = path or reserve(spark, "compacted")
    kept.repartitionById(max(1, n_groups + n_loose), F.col("group_id")).write.parquet(path)
    written = spark.read.schema(kept.schema).parquet(path)
    report = reconcile(rows, written, plan)
    return Compaction(plan, path, written, report)


def _last_group(target_bytes: int) -> Column:
    """The last group that a file's bytes run into, where it is larger than the target; else its own."""
    return F.when(F.col("bytes") > target_bytes, F.floor((F.col("start_byte") + F.col("bytes") - 1) / target_bytes)).otherwise(F.col("group_id")).cast("int")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``file_path`` and ``file_bytes`` of every file below a folder; files are listed, not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("_metadata.file_path", F.col("_metadata.file_size").alias("file_bytes"))


def compact_folder(spark: SparkSession, folder: str, format: str, target_bytes: int = TARGET_BYTES, path: str | None = None, pattern: str = "*", **options) -> tuple[DataFrame, DataFrame]:
    """Rewrite all files of a folder into Parquet files of about ``target_bytes``: the written rows and one line of counts.

    The folder's listing is frozen first; files that appear later are not read. Every row is
    written once, repeats included. ``balanced`` holds if as many rows are written as the
    listed files hold.
    """
    frozen = materialize(manifest(list_files(spark, folder, pattern)), "manifest")
    plan = materialize(plan_groups(frozen, target_bytes), "plan")
    last = plan.agg(F.max(_last_group(target_bytes))).first()[0]
    rows = spark.read.format(format).options(recursiveFileLookup="true", pathGlobFilter=pattern, **options).load(folder)
    named = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"))
    to = plan.select(F.col("file_path").alias("_path"), "group_id", (_last_group(target_bytes) - F.col("group_id") + 1).alias("_span"))
    listed = named.join(to, "_path")
    # rows of an oversized file are dealt by the block they lie in and their content
    part = F.pmod(F.xxhash64("_path", "_at", *(c for c, t in rows.dtypes if not t.startswith("map"))), F.col("_span").cast("bigint"))
    out = path or reserve(spark, "compacted")
    listed.select(*rows.columns, (F.col("group_id") + part).cast("int").alias("group_id")).repartitionById((last or 0) + 1, F.col("group_id")).drop("group_id").write.parquet(out)
    written = spark.read.schema(rows.schema).parquet(out)
    a = listed.agg(F.count(F.lit(1)).alias("n_rows"))
    b = written.agg(F.count(F.lit(1)).alias("n_written"))
    c = plan.agg(F.count(F.lit(1)).alias("n_files_before"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_before"))
    return written, a.crossJoin(b).crossJoin(c).withColumn("balanced", F.col("n_rows") == F.col("n_written"))  # one line each


def _holds_record() -> Column:
    return F.col("record_id").isNotNull() & (F.col("name").isNotNull() | F.col("status").isNotNull())


def reconcile(rows: DataFrame, written: DataFrame, plan: DataFrame) -> DataFrame:
    """One row of counts; ``balanced`` holds if every line is written, a repeat of a record, a line delivered again or empty, and no id is written twice."""
    a = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.when(_holds_record(), 0).otherwise(1)), F.lit(0)).alias("n_empty"))
    b = written.agg(F.count(F.lit(1)).alias("n_written"), F.countDistinct("record_id").alias("n_written_ids"), F.countDistinct("group_id").alias("n_files_after"))
    c = plan.agg(F.count(F.lit(1)).alias("n_files_before"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_before"))
    d = dropped(rows, written).agg(F.count(F.lit(1)).alias("n_repeats"))
    e = rows.join(written.select("record_id"), "record_id", "left_semi").agg(F.count(F.lit(1)).alias("_n"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)  # one line each
    out = out.withColumn("n_again", F.col("_n") - F.col("n_written")).drop("_n")
    return out.withColumn("balanced", (F.col("n_rows") == F.col("n_empty") + F.col("n_repeats") + F.col("n_again") + F.col("n_written")) & (F.col("n_written") == F.col("n_written_ids")))


def dropped(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Rows that hold a record but were not written: repeats of a written one."""
    return rows.filter(_holds_record()).join(written.select("record_id"), "record_id", "left_anti")
