"""Joins with checked shapes, override cascades, set algebra over keys, and radius joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import first_seen


def lookup(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], values: dict[str, Column | None]) -> DataFrame:
    """Left join that keeps the row count: of repeated right keys the first along ``order`` counts.

    ``values`` maps the right columns wanted to the default for misses (None: NULL). NULL keys
    match nothing. Right columns named like left ones replace them.
    """
    unique = first_seen(right.select(*on, *values, *order), [F.col(k) for k in on], order).select(*on, *values)
    clash = [c for c in values if c in left.columns]
    out = left.drop(*clash).join(unique, on, "left")
    for c, default in values.items():
        if default is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), default))
    return out


def override(left: DataFrame, overrides: DataFrame, key: str, rule: Column, name: str) -> DataFrame:
    """``name``: the override of the key where there is one, else what the rule says; ``from_override`` tells which."""
    o = overrides.select(key, F.col(name).alias("_o"))
    return left.withColumn("_r", rule).join(o, key, "left").withColumn(name, F.coalesce("_o", "_r")).withColumn("from_override", F.col("_o").isNotNull()).drop("_o", "_r")


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side, of both, and of one only."""
    x = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    y = b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.col("a") + F.col("b")).alias("n_both"), (F.count("a") - F.count(F.col("a") + F.col("b"))).alias("n_only_a"), (F.count("b") - F.count(F.col("a") + F.col("b"))).alias("n_only_b"))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if a key occurs on both sides."""
    hit = a.join(b.select(key), key, "left_semi").select(key).limit(1).collect()
    if hit:
        raise ValueError(f"{key} {hit[0][0]!r} is on both sides")


def radius_join(left: DataFrame, right: DataFrame, radius: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs within ``radius``: equi-join on grid cells of that edge and their 26 neighbours, then the distance.

    Columns of the sides come out with prefixes ``l_`` and ``r_``, with ``distance``. NULL and
    NaN coordinates pair with nothing.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")

    def cell(df: DataFrame, prefix: str) -> DataFrame:
        fine = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in xyz]
        df = df.filter(fine[0] & fine[1] & fine[2])
        return df.select(*(F.col(c).alias(prefix + c) for c in df.columns), *(F.floor(F.col(c) / radius).cast("bigint").alias(f"{prefix}c{i}") for i, c in enumerate(xyz)))

    a, b = cell(left, "l_"), cell(right, "r_")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for i in range(3):
        a = a.withColumn(f"_d{i}", F.explode(near)).withColumn(f"l_c{i}", F.col(f"l_c{i}") + F.col(f"_d{i}")).drop(f"_d{i}")
    on = [F.col(f"l_c{i}") == F.col(f"r_c{i}") for i in range(3)]
    d = F.sqrt(sum(((F.col("l_" + c) - F.col("r_" + c)) * (F.col("l_" + c) - F.col("r_" + c)) for c in xyz), F.lit(0.0)))
    return a.join(b, on).drop(*(f"{p}c{i}" for p in ("l_", "r_") for i in range(3))).withColumn("distance", d).filter(F.col("distance") <= radius)
