"""Ranks, islands, quartiles, priority selection and hash samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .identity import first_seen
from .prefix import quantiles, running_total, value_ranks


def average_rank(value: str, within: list[str]) -> Column:
    """Mean rank of ties inside a group, as a window column; for groups that fit a task."""
    w = W.partitionBy(*within)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*within, value)) - 1) / F.lit(2.0)


def percent_rank_of_ties(value: str, within: list[str]) -> Column:
    """Average rank over group size, in (0, 1]."""
    return average_rank(value, within) / F.count(F.lit(1)).over(W.partitionBy(*within))


def zscore(value: str, within: list[str]) -> Column:
    """Deviation from the group mean in sample standard deviations; NULL where that is 0 or undefined."""
    w = W.partitionBy(*within)
    s = F.stddev_samp(value).over(w)
    return F.when(s != 0, (F.col(value) - F.avg(value).over(w)) / s)


def top_n(df: DataFrame, within: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group along a total order, with ``rank``. Groups are cut before they are shuffled."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*order))).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def _numbered(df: DataFrame, column: str) -> DataFrame:
    ids = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("v")).distinct().withColumn("one", F.lit(1))
    return running_total(ids, "v", "one").select("v", "before")


def gaps(df: DataFrame, column: str) -> DataFrame:
    """``first_missing``, ``last_missing`` of every gap in a set of whole numbers: each number meets the next by its rank."""
    here = materialize(_numbered(df, column), "numbered")
    after = here.select(F.col("v").alias("w"), (F.col("before") - 1).alias("before"))
    return here.join(after, "before").select((F.col("v") + 1).alias("first_missing"), (F.col("w") - 1).alias("last_missing")).filter("first_missing <= last_missing")


def islands(df: DataFrame, column: str) -> DataFrame:
    """``first``, ``last``, ``n`` of every run of consecutive whole numbers; NULLs and repeats aside."""
    return _numbered(df, column).groupBy((F.col("v") - F.col("before")).alias("g")).agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


def compact_ranges(first: Column, last: Column) -> Column:
    """``3-7`` for a run, ``5`` for a single number."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def expand_ranges(text: Column, most: int) -> Column:
    """Distinct sorted numbers of an expression such as ``1-10,15``, kept within 1 and ``most``; parts that are no range say nothing."""
    parts = F.filter(F.split(text, r"\s*,\s*"), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    lo = lambda p: F.greatest(F.lit(1), F.split(p, "-")[0].cast("int"))
    hi = lambda p: F.least(F.lit(most), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(lo(p) <= hi(p), F.sequence(lo(p), hi(p))).otherwise(F.array().cast("array<int>"))))))


def quartile(df: DataFrame, value: str) -> DataFrame:
    """Adds ``quartile`` 1 to 4 by value edges, closed on the right, the lowest included; NULL stays NULL."""
    edges = quantiles(df, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    v = F.col(value)
    return df.crossJoin(edges).withColumn("quartile", F.when(v <= F.col("_q1"), 1).when(v <= F.col("_q2"), 2).when(v <= F.col("_q3"), 3).when(v.isNotNull(), 4)).drop("_q1", "_q2", "_q3")  # one line of edges


def global_rank(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """Adds ``rank`` (ties share the smallest) and ``pct`` = rank / n * 100 without a global sort in one task."""
    per = value_ranks(df, value)
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_t"))
    rank = (F.col("_t") - F.col("before") - F.col("n") + 1) if descending else F.col("before") + 1
    ranks = per.crossJoin(total).select(value, rank.cast("bigint").alias("rank"), (rank * 100.0 / F.col("_t")).alias("pct"))
    return df.join(ranks, value)


def cumulative(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """Running number of hits and their share along a unique descending order: ``rank``, ``found``, ``share``."""
    d = df.withColumn("_h", F.when(hit, 1).otherwise(0)).withColumn("_one", F.lit(1))
    b = running_total(d, order, {"_hits": "_h", "before": "_one"}, descending=True)
    total = d.agg(F.sum("_h").alias("_t"))
    return b.crossJoin(total).select(*df.columns, (F.col("before") + 1).cast("bigint").alias("rank"), (F.col("_hits") + F.col("_h")).cast("bigint").alias("found"), F.when(F.col("_t") > 0, (F.col("_hits") + F.col("_h")) / F.col("_t")).alias("share"))


def priority_select(df: DataFrame, key: list[str], priority: Column, order: list[Column]) -> DataFrame:
    """One row for each key: that of the smallest priority, then the first along ``order``; rows with NULL priority are out."""
    return first_seen(df.withColumn("priority", priority).filter("priority IS NOT NULL"), [F.col(k) for k in key], [F.col("priority"), *order])


def priority_cohort(df: DataFrame, target: list[str], key: list[str], cohort: str, whole: list[str], rest: str, n: int, order: list[str]) -> DataFrame:
    """One row for each (target, key): of its first cohort in ``whole`` and then ``rest``, the first along ``order``.

    Every pair of a cohort in ``whole`` stays, so a pair that an earlier cohort has is in no
    later one. Of the pairs left to ``rest`` each target keeps the first ``n`` along ``order``.
    Rows of other cohorts are out. The pick of a pair is a map-side minimum; only the pairs
    that are left over are ranked, and cut before they are shuffled.
    """
    rank = F.coalesce(*(F.when(F.col(cohort) == c, i) for i, c in enumerate([*whole, rest])))
    first = priority_select(df, [*target, *key], rank, [F.col(o) for o in order])
    taken = first.filter(F.col("priority") < len(whole)).select(df.columns)
    left = top_n(first.filter(F.col("priority") == len(whole)), target, [F.col(c) for c in [*order, *key]], n)
    return taken.unionByName(left.select(df.columns))


def error_rate(df: DataFrame, within: list[str], order: str, bad: str, last: int = 200, least: int = 50, limit: float = 0.05) -> DataFrame:
    """Adds ``rate``, the mean of ``bad`` over the ``last`` rows, and ``pause``: at least ``least`` of them are there and the rate is over ``limit``."""
    w = W.partitionBy(*within).orderBy(order).rowsBetween(1 - last, 0)
    return df.withColumn("rate", F.avg(bad).over(w)).withColumn("pause", (F.count(F.lit(1)).over(w) >= least) & (F.col("rate") > limit))


def hash_order(seed: int, *ids: str) -> Column:
    """A reproducible order that looks random: the SHA-256 of seed and ids."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)), 256)


def sample_n(df: DataFrame, strata: list[str], n: Column | int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows of each stratum in hash order (all of a smaller one).

    The strata are counted first; only rows whose hash lies below a bound that the ``n``
    smallest of a stratum pass all but surely (eight standard deviations) reach the sort.
    """
    take = n if isinstance(n, Column) else F.lit(n)
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"), F.max(take).alias("_take")).select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), "_n", "_take")
    held = df.join(size, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)]).withColumn("_h", hash_order(seed, *ids))
    share = (F.col("_take") + 8 * F.sqrt("_take") + 16) / F.col("_n")
    near = held.filter(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") <= share * float(2**32))
    w = W.partitionBy(*strata).orderBy("_h", *ids)
    return near.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= F.col("_take")).select(*df.columns)
