"""Rank statistics from counts of distinct values; p-values are scalars on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numerics
from .metrics import drawn_sums
from .prefix import running_total, value_ranks
from .ranking import sample_n


def _with_rank(df: DataFrame, value: str) -> DataFrame:
    per = value_ranks(df, value).select(F.col(value).alias("_v"), "avg_rank")
    return df.join(per, F.col(value) == F.col("_v")).drop("_v")


def group_ranks(df: DataFrame, value: str, group: str) -> tuple[DataFrame, float]:
    """``n`` and rank sum of each group over all values, and the sum of t^3 - t over ties."""
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    by = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    per = value_ranks(d, value)
    sums = by.join(per.select(value, "avg_rank"), value).groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("avg_rank")).alias("rank_sum"))
    ties = per.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))).first()[0] or 0.0
    return sums, float(ties)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: ``h`` with tie correction, ``k`` groups, ``n``, ``epsilon2`` = (h - k + 1) / (n - k), ``p``. NULLs below two groups."""
    sums, ties = group_ranks(df, value, group)
    r = sums.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s")).first()
    n, k = r["n"], r["k"]
    h = p = e = None
    if k >= 2 and n > k:
        c = 1 - ties / (n**3 - n)
        if c > 0:
            h = (12 / (n * (n + 1)) * r["s"] - 3 * (n + 1)) / c
            p, e = numerics.chi2_sf(h, k - 1), (h - k + 1) / (n - k)
    return df.sparkSession.createDataFrame([(k, n, h, e, p)], "k int, n bigint, h double, epsilon2 double, p double")


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row: ``u`` of the first group, two-sided ``p`` (normal approximation, tie and continuity corrected), rank-biserial and Cliff's delta with its band."""
    sums, ties = group_ranks(df.filter(F.col(group).isin(first, second)), value, group)
    rows = {r[group]: r for r in sums.collect()}  # two lines
    if first not in rows or second not in rows:
        out = (0, 0, None, None, None, None, None)
    else:
        n1, n2 = rows[first]["n"], rows[second]["n"]
        n = n1 + n2
        u = rows[first]["rank_sum"] - n1 * (n1 + 1) / 2
        var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
        p = min(1.0, 2 * numerics.norm_sf(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var))) if var > 0 else None
        delta = 2 * u / (n1 * n2) - 1
        # Bounds of the magnitude bands.
        band = next(b for x, b in ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"), (math.inf, "large")) if abs(delta) < x)
        out = (n1, n2, u, p, -delta, delta, band)
    return df.sparkSession.createDataFrame([out], "n1 bigint, n2 bigint, u double, p double, rank_biserial double, cliffs_delta double, magnitude string")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``n``, ``rho`` from average ranks, two-sided ``p``. Rows with NULL in either are out."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    a = _with_rank(d, "x").withColumnRenamed("avg_rank", "rx")
    r = _with_rank(a, "y").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "avg_rank").alias("rho")).first()
    rho = None if r["rho"] is None or math.isnan(r["rho"]) else r["rho"]
    return df.sparkSession.createDataFrame([(r["n"], rho, None if rho is None else numerics.spearman_p(rho, r["n"]))], "n bigint, rho double, p double")


def permutation(df: DataFrame, value: str, group: str, first, second, ids: list[str], n: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided permutation test of the difference of means: every draw gives each row a side by the hash of its ids, with the first group's share.

    One row: observed difference, draws, and ``p`` = (1 + draws at least as far) / (1 + draws).
    """
    d = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)).select(F.xxhash64(*ids).alias("_h"), F.col(value).cast("double").alias("v"), (F.col(group) == first).alias("g"), F.lit(1.0).alias("one"))
    seen = d.agg(F.avg(F.when(F.col("g"), F.col("v"))).alias("a"), F.avg(F.when(~F.col("g"), F.col("v"))).alias("b"), F.avg(F.col("g").cast("double")).alias("share"), F.sum("v").alias("all"), F.sum("one").alias("n")).first()
    if seen["a"] is None or seen["b"] is None:
        return df.sparkSession.createDataFrame([(None, 0, None)], "difference double, n_draws bigint, p double")
    far, share = abs(seen["a"] - seen["b"]), seen["share"]
    # the second side is what the first one leaves of the totals
    draws = drawn_sums(d, ["v", "one"], n, seed, [], lambda u: (u < share).astype(float))
    other = F.lit(float(seen["n"])) - F.col("one")
    r = draws.select(F.when((F.col("one") > 0) & (other > 0), F.col("v") / F.col("one") - (F.lit(float(seen["all"])) - F.col("v")) / other).alias("d")).agg(F.count("d").alias("n"), F.sum(F.when(F.abs("d") >= far - 1e-12, 1).otherwise(0)).alias("k")).first()
    return df.sparkSession.createDataFrame([(seen["a"] - seen["b"], r["n"], (1 + (r["k"] or 0)) / (1 + r["n"]))], "difference double, n_draws bigint, p double")


def top_share(df: DataFrame, score: str, key: str, marked: Column, percent: int = 5) -> DataFrame:
    """Hypergeometric test of the ``percent`` of rows with the highest scores, rounded up: one row with ``n``, ``marked``, ``drawn``, ``found`` and ``p`` (at least as many found).

    Equal scores enter by ``key``, which is unique; NULL scores come last.
    """
    rows = df.select(F.col(score).alias("s"), F.col(key).alias("k"), F.when(marked, 1).otherwise(0).alias("m"))
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("m"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("k")).first()
    n, k = total["n"], total["k"]
    drawn = -(-n * percent // 100)
    ahead = running_total(counts, "s", "c", descending=True)
    found = ahead.filter(F.col("before") + F.col("c") <= drawn).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    edge = ahead.filter((F.col("before") < drawn) & (F.col("before") + F.col("c") > drawn)).first()  # the score that enters in part
    if edge is not None:
        tied = running_total(rows.filter(F.col("s").eqNullSafe(F.lit(edge["s"]))).select("k", "m", F.lit(1).alias("c")), "k", "c")
        found += tied.filter(F.col("before") < drawn - edge["before"]).agg(F.sum("m")).first()[0]
    return df.sparkSession.createDataFrame([(n, k, drawn, found, numerics.hypergeom_sf(found, n, k, drawn) if n else None)], "n bigint, marked bigint, drawn bigint, found bigint, p double")


def holm_adjust(tests: DataFrame, p: str, within: list[str], name: str) -> DataFrame:
    """Adds ``adjusted``: Holm's step-down correction of the p-values of each family; ties by ``name``. NULL and NaN p-values are out.

    A family is a list of tests that are read together, so it fits a task.
    """
    rows = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    order = W.partitionBy(*within).orderBy(p, name)
    left = F.count(F.lit(1)).over(W.partitionBy(*within)) - F.row_number().over(order) + 1
    stepped = rows.withColumn("_a", F.least(F.lit(1.0), F.col(p) * left))
    return stepped.withColumn("adjusted", F.max("_a").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_a")


def matched_controls(rows: DataFrame, case: Column, strata: list[str], seed: int, *ids: str) -> DataFrame:
    """As many controls of each stratum as it has cases (all, where there are fewer), in hash order; strata without cases have none."""
    flagged = rows.withColumn("_case", F.coalesce(case, F.lit(False)))
    n = flagged.filter("_case").groupBy(*strata).agg(F.count(F.lit(1)).alias("_n_cases")).select(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(strata)), "_n_cases")
    pool = flagged.filter("NOT _case").join(n, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(strata)])
    return sample_n(pool.select(*rows.columns, "_n_cases"), strata, F.col("_n_cases"), seed, *ids).drop("_n_cases")
