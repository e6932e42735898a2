"""One surviving record for each group of duplicate records, by iterative truth discovery.

Every record of a group claims a value for each of its fields. A source's reliability and
the support of the values are estimated in turn: a value's support is the summed weight of
its claims' sources as a share of its group and field, a source's reliability the mean
support of its claims, its weight ``-ln(1 - reliability)``. When reliabilities stand still,
the value with the highest support wins each field.

What a (group, field) contributes to the reliabilities depends only on how many claims each
source makes for each of its values, not on the values. So the rounds run on the distinct
patterns with their multiplicities; the claims are read once before and once after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import forget, materialize

TOLERANCE = 1e-4
#: Rounds after which unfinished estimates are an error.
MAX_ROUNDS = 200
#: Reliabilities are kept within these, so that weights stay finite and no source is silenced.
LOW, HIGH = 0.01, 0.99


def reliabilities(votes: DataFrame, prior: DataFrame) -> DataFrame:
    """``source`` and ``reliability`` from ``votes`` (group, field, value, source, c), starting at ``prior`` (source, reliability).

    Sources missing in the prior start at the lowest reliability.
    """
    claims = F.sort_array(F.collect_list(F.struct("source", "c")))  # at most one entry a source
    values = votes.groupBy("group", "field", "value").agg(claims.alias("profile")).groupBy("group", "field", "profile").agg(F.count(F.lit(1)).alias("mult"))
    patterns = values.groupBy("group", "field").agg(F.sort_array(F.collect_list(F.struct("profile", "mult"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    flat = patterns.withColumn("pid", F.monotonically_increasing_id()).select("pid", "n", F.posexplode("pattern").alias("k", "v")).select("pid", "n", "k", F.col("v.mult").alias("mult"), F.explode("v.profile").alias("s")).select("pid", "n", "k", "mult", "s.source", "s.c")
    flat = materialize(flat, "patterns")
    sources = flat.select("source").distinct()
    now = materialize(sources.join(prior, "source", "left").select("source", F.greatest(F.least(F.coalesce("reliability", F.lit(LOW)), F.lit(HIGH)), F.lit(LOW)).alias("reliability"), F.lit(1.0).alias("moved")), "reliability")
    for _ in range(MAX_ROUNDS):
        x = flat.join(now.select("source", "reliability"), "source").withColumn("tau", -F.log1p(-F.col("reliability")))
        share = F.sum(F.col("c") * F.col("tau")).over(W.partitionBy("pid", "k")) / F.sum(F.col("c") * F.col("mult") * F.col("tau")).over(W.partitionBy("pid"))
        x = x.withColumn("share", share).groupBy("source", "reliability").agg((F.sum(F.col("n") * F.col("mult") * F.col("c") * F.col("share")) / F.sum(F.col("n") * F.col("mult") * F.col("c"))).alias("new"))
        new = F.greatest(F.least("new", F.lit(HIGH)), F.lit(LOW))
        old, now = now, materialize(x.select("source", new.alias("reliability"), F.abs(new - F.col("reliability")).alias("moved")), "reliability")
        forget(old)
        moved = now.agg(F.max("moved")).first()[0]
        if moved is None or moved < TOLERANCE:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved} after {MAX_ROUNDS} rounds")
    forget(flat)
    return now.select("source", "reliability")


def discover(claims: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reliabilities, and the support of every claimed value.

    ``claims``: group, field, value, source, at (recency). The second frame has group, field,
    value, support (share of the weight claimed in its group and field), at (latest claim) and
    ``wins`` (highest support; on ties the latest claim, then the smallest value).
    """
    votes = materialize(claims.filter("value IS NOT NULL").groupBy("group", "field", "value", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("at")), "votes")
    learnt = reliabilities(votes, prior)
    weighed = votes.join(learnt, "source").groupBy("group", "field", "value").agg(F.sum(F.col("c") * -F.log1p(-F.col("reliability"))).alias("tau"), F.max("at").alias("at"))
    weighed = materialize(weighed, "weighed")
    # One line per (group, field), reduced map-side: total weight and the winner.
    top = weighed.groupBy("group", "field").agg(F.sum("tau").alias("total"), F.max(F.struct(F.round("tau", 9).alias("tau"), F.col("at").alias("at"))).alias("top"))
    near = weighed.join(top, ["group", "field"])
    first = near.filter((F.round("tau", 9) == F.col("top.tau")) & F.col("at").eqNullSafe(F.col("top.at"))).groupBy("group", "field").agg(F.min("value").alias("winner"))
    support = near.join(first, ["group", "field"]).select("group", "field", "value", (F.col("tau") / F.col("total")).alias("support"), "at", (F.col("value") == F.col("winner")).alias("wins"))
    support = materialize(support, "support")
    forget(votes)
    forget(weighed)
    return learnt, support
