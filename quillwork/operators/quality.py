"""Integrity checks that report every violation at once, and double-run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .identity import content_hash


def violations(df: DataFrame, checks: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """``check``, ``n_violations`` for row predicates that should hold (NULL counts as broken), from one scan; ``unique`` adds a key check."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(f"v{i}") for i, c in enumerate(checks.values())))
    lines = F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(F.col(f"v{i}"), F.lit(0)).cast("bigint").alias("n_violations")) for i, name in enumerate(checks)))
    out = counts.select(F.explode(lines).alias("l")).select("l.*")
    if unique:
        rep = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_violations"))
        out = out.unionByName(rep.select(F.lit("unique " + ", ".join(unique)).alias("check"), "n_violations"))
    return out


def mismatches(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks: ``key``, ``expected``, ``actual``."""
    a, b = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def double_run(build: Callable[[], DataFrame], line: Column) -> DataFrame:
    """The content hash of a result, the number of its lines, and whether a second run from the same inputs has the ``same``."""
    first, again = content_hash(build(), line), content_hash(build(), line).select(F.col("content_hash").alias("_h"))
    return first.crossJoin(again).select("content_hash", "n_lines", F.col("content_hash").eqNullSafe(F.col("_h")).alias("same"))  # one line each


def hash_gate(source: Callable[[], DataFrame], line: Column, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of a stage with the content hash of its input, and whether the input is ``unchanged`` after it.

    The first hash and the stage's result are written before the input is hashed again.
    """
    before = materialize(content_hash(source(), line), "gate")
    result = materialize(stage(source()), "stage")
    after = content_hash(source(), line).select(F.col("content_hash").alias("_h"))
    return before.crossJoin(after).crossJoin(result).select("content_hash", "n_lines", F.col("content_hash").eqNullSafe(F.col("_h")).alias("unchanged"), *result.columns)


def idempotent(df: DataFrame, column: str, f: Callable[[Column], Column]) -> DataFrame:
    """One row: values, and those where applying ``f`` twice differs from once."""
    once = f(F.col(column))
    return df.filter(F.col(column).isNotNull()).select(once.alias("a")).select("a", f(F.col("a")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)), F.lit(0)).cast("bigint").alias("n_changed"))


def evidence_cascade(candidates: DataFrame, known: DataFrame, assays: DataFrame, key: str, strong: float = 6.0, weak: float = 5.0) -> DataFrame:
    """``key``, ``evidence`` and ``n_reports``: the first tier that says something about a candidate.

    ``known`` has the keys of a curated base; ``assays`` one line a key with exact_best, exact_n,
    related_best and related_n. A known key comes first; then the best value on the exact
    target (supported from ``strong`` on, partly from ``weak`` on, else contradicted), then any
    value on a related target, then no report.
    """
    exact = F.when(F.col("exact_best") >= strong, "supported").when(F.col("exact_best") >= weak, "partly supported").when(F.col("exact_best").isNotNull(), "contradicted")
    joined = candidates.join(known.withColumn("_known", F.lit(True)), key, "left").join(assays, key, "left")
    evidence = F.coalesce(F.when(F.col("_known"), "known"), exact, F.when(F.col("related_best").isNotNull(), "related target only"), F.lit("no report"))
    n = F.when(F.col("_known"), 1).when(F.col("exact_n") > 0, F.col("exact_n")).when(F.col("related_n") > 0, F.col("related_n")).otherwise(0)
    return joined.select(key, evidence.alias("evidence"), n.cast("bigint").alias("n_reports"))


def one_row(spark: SparkSession, values: dict[str, tuple[str, object]]) -> DataFrame:
    """A single typed row."""
    return spark.createDataFrame([tuple(v for _, v in values.values())], ", ".join(f"{k} {t}" for k, (t, _) in values.items()))
