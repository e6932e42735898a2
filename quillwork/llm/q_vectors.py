"""Queries on compound vectors: most similar compounds (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import neighbours

DIM, K = 64, 5


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other compounds of each compound."""
    return neighbours.neighbours(table(spark, sf_dir, "compound_vectors"), "inchikey_connectivity", "vec", DIM, K)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at a similarity of at least 0.8 of which one is among the other's five most similar."""
    near = p5_neighbours(spark, sf_dir).filter("similarity >= 0.8")
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


_UNIT = """
WITH v AS (SELECT inchikey_connectivity AS k, vec::DOUBLE[] AS v FROM compound_vectors WHERE vec IS NOT NULL AND len(vec) = 64),
u AS (SELECT k, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v WHERE NOT list_contains(list_transform(v, lambda x: isnan(x)), true)),
p AS (SELECT a.k AS a, b.k AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM u a JOIN u b ON a.k <> b.k WHERE a.n > 0 AND b.n > 0),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS i FROM p)
"""

QUERIES = {"p5_neighbours": p5_neighbours, "p5_found": p5_found}
SQL = {"p5_found": _UNIT + "SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM r WHERE i <= 5 AND s >= 0.8"}
