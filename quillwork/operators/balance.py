"""Whole groups into parts of wanted shares, with like label counts in every part.

One rule for groups of every size. Groups of one size class (sizes within a ninth of each
other) and one main label are alike enough to be dealt by number: each class, the largest
first, gives every part the whole number of groups that its shortage of that label is worth,
and the few that are left over go one by one where least is added beyond a target, which nothing
can mend later, and then where the squared relative deviation of label counts grows least. A class of one group is placed by its exact counts. So the driver sees one
line for each class and label, of which there are at most a few thousand whatever the number
of groups, and which of a class's groups go where is decided by the order of their hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Size classes for each doubling of the size.
CLASSES = 8
#: Buckets of hashes that the groups of a class are numbered in.
BUCKETS = 4096
MAX_LABELS = 64


def _best(have: np.ndarray, target: np.ndarray, v: np.ndarray, closed: np.ndarray) -> int:
    """The part for label counts ``v``: least excess over its targets first, then least deviation from them."""
    scale = np.maximum(target, 1.0)
    after, before = (have + v - target) / scale, (have - target) / scale
    excess = (np.maximum(after, 0) ** 2 - np.maximum(before, 0) ** 2).sum(1)
    size, goal = have.sum(1), target.sum(1)
    deviation = (after**2 - before**2).sum(1) + ((size + v.sum() - goal) ** 2 - (size - goal) ** 2) / np.maximum(goal, 1.0) ** 2
    return min((k for k in range(len(target)) if not closed[k]), key=lambda k: (round(excess[k], 9), round(deviation[k], 9), k))


def deal(classes: list[tuple[int, int, int, np.ndarray]], target: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """How many groups of each (size class, main label) every part gets.

    ``classes`` has (size class, main label, groups, label counts of all of them); ``target``
    the label counts wanted of each part.
    """
    have = np.zeros_like(target)
    closed = target.sum(1) <= 0
    if closed.all():
        return []
    out = []
    for size, main, m, total in sorted(classes, key=lambda c: (-c[0], c[1])):
        mean = total / m
        short = np.where(closed, 0.0, np.maximum(target[:, main] - have[:, main], 0.0))
        if short.sum() <= 0:
            short = np.where(closed, 0.0, target.sum(1))
        count = np.floor(m * short / short.sum()).astype(int)
        have += count[:, None] * mean
        for _ in range(m - int(count.sum())):  # fewer than there are parts
            k = _best(have, target, mean, closed)
            count[k] += 1
            have[k] += mean
        out.append((size, main, count.tolist()))
    return out


def place(records: DataFrame, group: str, label: str, shares: list[float], seed: int = 42) -> DataFrame:
    """``group``, ``n`` and ``part`` (0 to len(shares) - 1) of every group of ``records``.

    NULL groups are left out, a NULL label is a label of its own; more than MAX_LABELS labels
    are an error. Parts with a share of 0 get nothing. Shares hold as far as a group that is
    larger than a whole part allows. Empty input gives no lines.
    """
    want = np.array(shares, float)
    if (want < 0).any() or not want.sum() > 0:
        raise ValueError("shares must be positive")
    want /= want.sum()
    named = F.coalesce(F.col(label).cast("string"), F.lit("\x00null")).alias("_label")
    counts = materialize(records.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g"), named).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    totals = {r[0]: r[1] for r in counts.groupBy("_label").agg(F.sum("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sorted(totals) or ["\x00null"]
    each = [F.col(f"n{i}") for i in range(len(labels))]
    wide = counts.groupBy("_g").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("_label") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(labels)))
    most = each[0] if len(each) == 1 else F.greatest(*each)
    wide = wide.withColumn("main", (F.array_position(F.array(*each), most) - 1).cast("int")).withColumn("size", F.floor(CLASSES * F.log2(F.col("n").cast("double")) + 1e-9).cast("int"))
    wide = materialize(wide.withColumn("h", F.xxhash64(F.lit(seed), "_g")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "groups")
    classes = wide.groupBy("size", "main").agg(F.count(F.lit(1)).alias("m"), *(F.sum(c).alias(f"n{i}") for i, c in enumerate(each))).collect()  # one line a class and label
    target = np.outer(want, [totals.get(x, 0) for x in labels])
    dealt = deal([(r["size"], r["main"], r["m"], np.array([r[f"n{i}"] for i in range(len(labels))], float)) for r in classes], target)
    quota = records.sparkSession.createDataFrame([(s, m, np.cumsum(c).tolist()) for s, m, c in dealt], "size int, main int, upto array<bigint>")
    # Groups of a class are numbered by hash: inside a bucket by a window, across buckets by their counts.
    key = ["size", "main"]
    sums = wide.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("b"))
    before = sums.select(*key, "bucket", (F.sum("b").over(W.partitionBy(*key).orderBy("bucket")) - F.col("b")).alias("before"))
    inside = F.row_number().over(W.partitionBy(*key, "bucket").orderBy("h", "_g")) - 1
    at = wide.withColumn("i", inside).join(before, [*key, "bucket"]).join(quota, key)
    part = F.size(F.filter("upto", lambda e: e <= F.col("before") + F.col("i"))).cast("int")
    return at.select(F.col("_g").alias(group), "n", part.alias("part"))
