"""Running totals and ranks over a whole table, without sorting it in one task.

Rows are range partitioned by the order; a window inside each partition plus the totals of
the partitions before it give the running value. Ties and hot values are aggregated before,
so equal values are one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, order: str, value: str | dict[str, str], within: list[str] = (), descending: bool = False) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the lines ahead of each line, per ``within``.

    Several sums come out of one pass: then ``value`` names their columns, as {output: input}.
    ``order`` is unique per ``within``; NULL orders come last. An empty table stays empty.
    The number of ranges follows the size of the data (adaptive execution joins small ones).
    """
    sums = {"before": value} if isinstance(value, str) else value
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    laid = materialize(df.repartitionByRange(*within, key).withColumn("_pid", F.spark_partition_id()), "ranged")
    parts = laid.groupBy(*within, "_pid").agg(*(F.sum(c).alias(f"_s_{o}") for o, c in sums.items()))  # one line a partition and group
    w = W.partitionBy(*within).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offset = parts.select(*within, "_pid", *(F.coalesce(F.sum(f"_s_{o}").over(w), F.lit(0)).alias(f"_off_{o}") for o in sums))
    inner = W.partitionBy(*within, "_pid").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    near = laid.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{o}") for o, c in sums.items()))
    on = [near[c].eqNullSafe(offset[c]) for c in [*within, "_pid"]]
    joined = near.join(offset, on, "left")
    return joined.select(*(near[c] for c in df.columns), *((F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in sums))


def value_ranks(df: DataFrame, value: str, within: list[str] = ()) -> DataFrame:
    """One line for each distinct value: ``n``, ``before`` (how many are smaller) and ``avg_rank`` (ties share the mean rank)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, value, "n", list(within))
    return ranked.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2.0)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], within: list[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one line for each of ``within``, one column for each of ``probs``.

    They are read off the ranks of distinct values, so no task holds a group's values. NULL
    values are out (NaN is the greatest); a group without values has no line.
    """
    ranks = value_ranks(df, value, list(within))
    total = ranks.groupBy(*within).agg(F.sum("n").alias("_n"))
    if within:
        names = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
        total = total.select(*names, "_n")
        both = ranks.join(total, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)])
    else:
        both = ranks.crossJoin(total)  # one line
    at = {o: (F.col("_n") - 1) * F.lit(float(p)) for o, p in probs.items()}
    here = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value)))
    ends = both.groupBy(*within).agg(F.max("_n").alias("_n"), *(e for o, h in at.items() for e in (here(F.floor(h)).alias(f"_lo_{o}"), here(F.ceil(h)).alias(f"_hi_{o}"))))
    mix = lambda o, h: F.when(F.col(f"_lo_{o}") == F.col(f"_hi_{o}"), F.col(f"_lo_{o}")).otherwise((F.ceil(h) - h) * F.col(f"_lo_{o}") + (h - F.floor(h)) * F.col(f"_hi_{o}"))
    return ends.select(*within, *(mix(o, h).alias(o) for o, h in at.items()))
