"""Repeated measurements to labels: predicates, aggregates per key, conflict rules, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import n_if

#: Measurement types and assay classes that count.
TYPES = ("IC50", "Ki", "Kd", "EC50")
ASSAYS = ("B", "F")
CONFIDENCE = (8, 9)


def usable() -> Column:
    """Exact relation, a value in nM of a known type, not a duplicate, no validity remark.

    A plain conjunction, so that a filter on it reaches the scan; NULL where a flag is NULL,
    which filters and counts take as no.
    """
    remark = F.col("data_validity_comment").isNull() | (F.col("data_validity_comment") == "")
    return (F.col("standard_relation") == "=") & F.col("standard_value").isNotNull() & (F.col("standard_units") == "nM") & F.col("standard_type").isin(*TYPES) & (F.col("potential_duplicate") == 0) & remark


def strict() -> Column:
    """Usable, of a trusted assay class and confidence, with a target. NULL counts as no."""
    return usable() & F.col("assay_type").isin(*ASSAYS) & F.col("confidence_score").isin(*CONFIDENCE) & F.col("tid").isNotNull()


def pool() -> Column:
    """Rows whose measure may label a key: as ``usable`` with a NULL remark only, and a measure. NULL counts as no."""
    return (F.col("standard_relation") == "=") & (F.col("potential_duplicate") == 0) & F.col("data_validity_comment").isNull() & F.col("pchembl_value").isNotNull() & ~F.isnan("pchembl_value")


def imputed(measure: Column, value: Column) -> Column:
    """The measure, else ``9 - log10(value)`` for positive values in nM."""
    return F.coalesce(F.nanvl(measure, F.lit(None).cast("double")), F.when(value > 0, 9 - F.log10(value)))


def per_key(rows: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Count, median, minimum and maximum of a measure for each key."""
    return rows.groupBy(*keys).agg(F.count(measure).alias("n_records"), F.percentile(measure, F.lit(0.5)).alias("median_value"), F.min(measure).alias("min_value"), F.max(measure).alias("max_value"))


def conflict_any(threshold: float) -> Column:
    """Some record on either side of the threshold."""
    return (F.col("n_records") > 1) & (F.col("min_value") < threshold) & (F.col("max_value") >= threshold)


def conflict_wide(threshold: float, spread: float = 1.0) -> Column:
    """Records on either side, further apart than ``spread``."""
    return (F.col("min_value") < threshold) & (F.col("max_value") >= threshold) & ((F.col("max_value") - F.col("min_value")) > spread)


def label(threshold: float, conflict: Column) -> Column:
    """1 or 0 by the median, NULL (never NaN) on conflict."""
    return F.when(~conflict, F.when(F.col("median_value") >= threshold, 1.0).otherwise(0.0))


def label_table(rows: DataFrame, keys: list[str], measure: str, thresholds: tuple[float, ...] = (6.0, 5.0)) -> DataFrame:
    """Aggregates per key with a conflict flag and a label for each threshold."""
    out = per_key(rows, keys, measure)
    for t in thresholds:
        out = out.withColumn(f"conflict_t{t:g}", conflict_wide(t)).withColumn(f"label_t{t:g}", label(t, conflict_wide(t)))
    return out


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``step_no``, ``step``, ``n``, ``pct_of_input`` for nested conditions, from a single scan."""
    counts = rows.agg(F.count(F.lit(1)).alias("c0"), *(n_if(c).alias(f"c{i + 1}") for i, (_, c) in enumerate(steps)))
    lines = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"c{i}").alias("n")) for i, name in enumerate(["input", *(s for s, _ in steps)])))
    return counts.select("c0", F.explode(lines).alias("s")).select("s.step_no", "s.step", "s.n", F.when(F.col("c0") > 0, F.col("s.n") * 100.0 / F.col("c0")).otherwise(0.0).alias("pct_of_input"))
