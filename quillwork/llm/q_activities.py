"""Queries on activity values: percentiles (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import layer_key
from ..session import materialize, table
from . import quantiles
from .compounds import layer_of_molregno

PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def valid_values(activities: DataFrame) -> DataFrame:
    """Of each activity_id the row loaded last (on ties the greatest values), where its pchembl_value is valid.

    Valid is greater than 0 and less than 15, not NaN. NULL loaded_at is oldest; rows without
    activity_id are left out, as are those without molregno.
    """
    last = activities.filter("activity_id IS NOT NULL").groupBy("activity_id").agg(F.max(F.struct("loaded_at", "pchembl_value", "molregno", "batch_day")).alias("r"))
    return last.select("r.molregno", "r.batch_day", F.col("r.pchembl_value").alias("value")).filter("molregno IS NOT NULL AND value > 0 AND value < 15 AND NOT isnan(value)")


def day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary for each layer and batch day.

    Values are collapsed by molregno and day before they meet their layer, so a molregno that
    holds a third of all rows comes to that join with at most k lines a day.
    """
    by_molecule = quantiles.summarise(valid_values(table(spark, sf_dir, "activities")), ["molregno", "batch_day"])
    layers = layer_of_molregno(table(spark, sf_dir, "compound_bioactivity_raw"))
    return by_molecule.join(layers, "molregno").select(F.col("layer").alias("inchikey_connectivity"), "batch_day", "value", "weight", "err")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each layer, its days summarised apart and combined."""
    merged = quantiles.merge(day_summaries(spark, sf_dir), ["inchikey_connectivity"])
    return quantiles.percentiles(merged, ["inchikey_connectivity"], PROBS)


def p4_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each batch day, from the same summaries."""
    return quantiles.percentiles(quantiles.merge(day_summaries(spark, sf_dir), ["batch_day"]), ["batch_day"], PROBS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with at least 50 values whose 90th percentile exceeds the 10th by 2.5 or more."""
    return p4_percentiles(spark, sf_dir).filter(F.col("n") >= 50).filter(F.round(F.col("p90") - F.col("p10"), 6) >= 2.5).select("inchikey_connectivity")


_VALUES = r"""
WITH l AS (SELECT activity_id, molregno, pchembl_value AS value, batch_day, row_number() OVER (PARTITION BY activity_id ORDER BY loaded_at DESC) AS i FROM activities),
k AS (SELECT molregno, min(upper(regexp_replace(inchikey_connectivity, '^\s+|\s+$', '', 'g'))) AS key FROM compound_bioactivity_raw WHERE regexp_matches(inchikey_connectivity, '[\p{L}\p{N}]') GROUP BY 1),
v AS (SELECT key AS inchikey_connectivity, value FROM l JOIN k USING (molregno) WHERE i = 1 AND value > 0 AND value < 15)
"""

QUERIES = {"p4_percentiles": p4_percentiles, "p4_days": p4_days, "p4_found": p4_found}
_PERCENTS = ", ".join(f"quantile_disc(value, {p}) AS {quantiles.name_of(p)}" for p in PROBS)
#: Summaries of keys with at most ``quantiles.K`` values are exact, so exact percentiles must come out; larger keys are tested against their counted bound.
SQL = {
    "p4_percentiles": _VALUES + f"SELECT inchikey_connectivity, count(*) AS n, 0.0 AS rank_error, {_PERCENTS} FROM v GROUP BY 1",
    "p4_days": _VALUES.replace("SELECT key AS inchikey_connectivity, value", "SELECT batch_day, value") + f"SELECT batch_day, count(*) AS n, 0.0 AS rank_error, {_PERCENTS} FROM v GROUP BY 1",
    "p4_found": _VALUES + "SELECT inchikey_connectivity FROM v GROUP BY 1 HAVING count(*) >= 50 AND round(quantile_disc(value, 0.9) - quantile_disc(value, 0.1), 6) >= 2.5",
}
