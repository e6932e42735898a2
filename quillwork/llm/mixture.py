"""Combining sources so that each has its target share of the total size.

Every record of a source is to come ``e = min(target / size, max_repeats)`` times. The whole
part of ``e`` is certain; the fractions are settled by pivotal rounding: two records that are
still open fight, mass moves from one to the other with the odds that keep both expectations,
and one of them becomes 0 or 1. Each input partition settles its own records, the likest in
size against each other, and is left with at most one open record a source; these residuals
meet in a reduction tree. So the number of extra copies of each source is its expectation, up
to one record, and its tokens are close to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws
from ..session import materialize
from . import tokens

FAN_IN = 64
EPS = 1e-9


def source_key(c: Column) -> Column:
    """A source name without letter case and outer white space; hyphen, underscore and white space are alike."""
    return F.regexp_replace(F.lower(strip_ws(c)), r"(?U)[-_\s]", "_")


def shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One line for each target source: size, target and expected copies of its records.

    ``sized``: skey, tokens; ``targets``: source, target_weight, max_repeats. The mix has the
    total size of all records of target sources. Weights that are NULL, NaN or negative count
    as 0, NULL max_repeats as 1; targets with a NULL source are left out; of targets that
    spell one source the weights add up and the smallest name and cap hold. ``capped``: the
    target is more than max_repeats times the source's size.
    """
    weight = F.when(F.col("target_weight").isNotNull() & ~F.isnan("target_weight") & (F.col("target_weight") > 0), F.col("target_weight")).otherwise(0.0)
    goal = targets.filter("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("skey")).agg(F.min("source").alias("source"), F.sum(weight).alias("weight"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    sizes = sized.groupBy("skey").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n_records"))
    line = goal.join(sizes, "skey", "left").fillna(0, ["size", "n_records"])
    whole = line.agg(F.sum("weight").alias("w"), F.sum("size").alias("total"))
    line = line.crossJoin(whole).withColumn("target_share", F.when(F.col("w") > 0, F.col("weight") / F.col("w")).otherwise(0.0))  # one line of totals
    line = line.withColumn("target_tokens", F.col("target_share") * F.col("total")).withColumn("capped", F.col("target_tokens") > F.col("max_repeats") * F.col("size"))
    copies = F.when(F.col("capped"), F.col("max_repeats").cast("double")).when(F.col("size") > 0, F.col("target_tokens") / F.col("size")).otherwise(0.0)
    return line.select("skey", "source", "max_repeats", "n_records", "size", "target_share", "target_tokens", "capped", copies.alias("expected_copies"))


def _uniform(seed: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit seeds, other ones at every level of the tree."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def settle(prob: np.ndarray, u: np.ndarray, at: np.ndarray, open_at: int = -1) -> int:
    """Pivotal rounding of ``prob`` in place along the positions ``at``; returns the open position or -1."""
    for j in at:
        q = prob[j]
        if q <= EPS or q >= 1 - EPS:
            prob[j] = round(q)
            continue
        if open_at < 0:
            open_at = j
            continue
        p = prob[open_at]
        s = p + q
        if s < 1:
            stays = u[j] * s < p
            winner, loser = (open_at, j) if stays else (j, open_at)
            prob[loser], prob[winner], open_at = 0.0, s, winner
        else:
            # one becomes 1, the other keeps s - 1
            first = u[j] * (2 - s) < 1 - q
            one, rest = (open_at, j) if first else (j, open_at)
            prob[one], prob[rest], open_at = 1.0, s - 1, rest
        if prob[open_at] <= EPS or prob[open_at] >= 1 - EPS:
            prob[open_at] = round(prob[open_at])
            open_at = -1
    return int(open_at)


def _round(level: int, last: bool):
    """Settle the records of a partition (level 0) or of a group of residuals, source by source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for pdf in batches:
            pdf = pd.concat([*held.values(), pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            prob = pdf["prob"].to_numpy(float).copy()
            u = _uniform(pdf["seed"].to_numpy("int64").view(np.uint64), level)
            order = np.lexsort((pdf["seed"].to_numpy(), pdf["tokens"].to_numpy(), pdf["skey"].to_numpy(str)))
            left = []
            names = pdf["skey"].to_numpy(str)[order]
            edges = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)]
            for a, b in zip(edges[:-1], edges[1:]):
                k = settle(prob, u, order[a:b])
                if k >= 0:
                    left.append(k)
            pdf["prob"] = prob
            held = {pdf["skey"][k]: pdf.iloc[[k]] for k in left}
            yield pdf.drop(index=left)
        if held:
            rest = pd.concat(held.values(), ignore_index=True)
            if last:
                u = _uniform(rest["seed"].to_numpy("int64").view(np.uint64), level + 1)
                rest["prob"] = (u < rest["prob"].to_numpy()).astype(float)
            yield rest

    return run


def mix(records: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str = tokens.VOCABULARY, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``copies`` of every record of a target source, and the report on shares.

    ``records``: ``key``, ``text``, ``source``. The first frame has key, source (as in the
    targets), tokens and copies, 0 included; the second one line for each target source with
    its size, target and actual tokens and shares. Records with a NULL source or of no target
    source are left out; NULL and empty texts have 0 tokens but are records like any other.
    The draw depends on ``seed``, the keys and the file layout only. Empty tables give no
    copies and a report with zeros.
    """
    rows = records.filter("source IS NOT NULL").select(F.col(key), source_key(F.col("source")).alias("skey"), "text").join(targets.filter("source IS NOT NULL").select(source_key(F.col("source")).alias("skey")).distinct(), "skey", "left_semi")
    sized = materialize(rows.select(key, "skey", tokens.count(F.col("text"), vocabulary).alias("tokens")), "sized")
    plan = materialize(shares(sized, targets), "shares")
    unit = sized.join(plan.select("skey", "expected_copies"), "skey").select(
        key, "skey", "tokens", F.floor("expected_copies").cast("int").alias("base"), (F.col("expected_copies") - F.floor("expected_copies")).alias("prob"), F.xxhash64(F.lit(seed), F.col(key), "tokens").alias("seed"), F.spark_partition_id().alias("part")
    )
    settled = materialize(unit.mapInPandas(_round(0, False), unit.schema), "settled")
    is_open = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
    done, rest = settled.filter(~is_open), materialize(settled.filter(is_open), "residuals")
    top = rest.agg(F.max("part")).first()[0]
    parts = 0 if top is None else top + 1
    level = 1
    while parts:
        parts = -(-parts // FAN_IN)
        rest = rest.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).repartition(F.col("part")) if parts > 1 else rest.withColumn("part", F.lit(0)).repartition(1)
        rest = _by_part(rest, level, parts == 1)
        level += 1
        if parts == 1:
            break
    copies = done.unionByName(rest).select(key, "skey", "tokens", (F.col("base") + F.round("prob").cast("int")).alias("copies"))
    actual = copies.groupBy("skey").agg(F.sum(F.col("copies") * F.col("tokens")).alias("actual_tokens"), F.max("copies").alias("most_copies"), F.sum("copies").alias("n_copies"))
    line = plan.join(actual, "skey", "left").fillna(0, ["actual_tokens", "most_copies", "n_copies"])
    whole = line.agg(F.sum("actual_tokens").alias("all_tokens"))
    report = line.crossJoin(whole).withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("actual_tokens") / F.col("all_tokens")).otherwise(0.0)).drop("skey", "all_tokens")
    return copies.join(plan.select("skey", "source"), "skey").select(key, "source", "tokens", "copies"), report


def _by_part(rest: DataFrame, level: int, last: bool) -> DataFrame:
    """Residuals of each part fight on; a part has at most FAN_IN of each source."""
    schema = rest.schema
    if last:
        return rest.sortWithinPartitions("skey", "tokens", "seed").mapInPandas(_round(level, True), schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_round(level, False)(iter([pdf])), ignore_index=True)

    return rest.groupBy("part").applyInPandas(one, T.StructType(schema.fields))
