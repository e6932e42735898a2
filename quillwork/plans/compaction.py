"""Queries of the small-file consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction as op
from ..session import materialize, table

#: The name cache's files are a few hundred bytes; the consolidated ones take this much of them.
NAMES_TARGET_BYTES = 16 * 1024 * 1024


def p1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping of the name cache's files."""
    frozen = materialize(op.manifest(table(spark, sf_dir, "names")), "manifest")
    return op.plan_groups(frozen, NAMES_TARGET_BYTES)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each group of files."""
    return p1_plan(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite the name cache and reconcile the counts."""
    return op.compact(table(spark, sf_dir, "names"), NAMES_TARGET_BYTES).report


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat another record: what the rewritten files leave out."""
    rows = table(spark, sf_dir, "names").select("record_id", "file_path", "file_bytes", "written_at", "name", "status", "cids")
    return op.dropped(rows, op.compact(rows, NAMES_TARGET_BYTES).written).select("record_id")


_PLAN = f"""
WITH m AS (SELECT file_path, substring(md5(file_path), 1, 3) AS shard, CAST(coalesce(max(file_bytes), 0) AS BIGINT) AS bytes, count(*) AS n_rows
           FROM names WHERE file_path IS NOT NULL GROUP BY file_path),
p AS (SELECT file_path, bytes, n_rows, CAST(coalesce(sum(bytes) OVER (ORDER BY shard, file_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM m),
plan AS (SELECT file_path, bytes, n_rows, start_byte, CAST(start_byte // {NAMES_TARGET_BYTES} AS INTEGER) AS group_id FROM p)
"""

_KEYS = r"""
WITH k AS (SELECT *, lower(trim(regexp_replace(nfc_normalize(name), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g'))) AS n,
                  array_to_string(list_sort(list_distinct(coalesce(cids, []))), ',') AS c
           FROM names WHERE name IS NOT NULL OR status IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY n, status, c ORDER BY written_at NULLS LAST, record_id) AS i FROM k)
"""

QUERIES = {"p1_plan": p1_plan, "p1_groups": p1_groups, "p1_report": p1_report, "p1_found": p1_found}
SQL = {
    "p1_plan": _PLAN + "SELECT file_path, bytes, n_rows, start_byte, group_id FROM plan",
    "p1_groups": _PLAN + "SELECT group_id, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM plan GROUP BY group_id",
    "p1_found": _KEYS + "SELECT record_id FROM r WHERE i > 1",
    "p1_report": _PLAN.rstrip() + ", " + _KEYS.strip().removeprefix("WITH ") + """
SELECT (SELECT count(*) FROM names) AS n_rows, (SELECT count(*) FROM names WHERE name IS NULL AND status IS NULL) AS n_empty,
       (SELECT count(*) FROM r WHERE i = 1) AS n_written, (SELECT count(*) FROM r WHERE i = 1) AS n_written_ids,
       (SELECT count(DISTINCT coalesce(group_id, -1)) FROM r LEFT JOIN plan USING (file_path) WHERE i = 1) AS n_files_after,
       (SELECT count(*) FROM plan) AS n_files_before, (SELECT CAST(sum(bytes) AS BIGINT) FROM plan) AS bytes_before,
       (SELECT count(*) FROM r WHERE i > 1) AS n_repeats, 0::BIGINT AS n_again, true AS balanced""",
}
