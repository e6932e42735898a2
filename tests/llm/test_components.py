import random

import pytest
from pyspark.sql import functions as F

from quillwork.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, e in edges:
        root[find(("n", n))] = find(("e", e))
    groups = {}
    for n in {n for n, _ in edges}:
        groups.setdefault(find(("n", n)), []).append(n)
    return {n: min(g) for g in groups.values() if len(g) > 1 for n in g}


def run(spark, edges):
    df = spark.createDataFrame([(n, e) for n, e in edges], "node bigint, entity string")
    return {r.node: r.label for r in components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), f"e{rng.randrange(170)}") for _ in range(220)]
    assert run(spark, edges) == brute(edges)


def test_long_chain(spark):
    edges = [(i, f"e{i + d}") for i in range(120) for d in (0, 1)]
    assert run(spark, edges) == {i: 0 for i in range(120)}


def test_hot_entity_and_nulls(spark):
    df = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("e%d", "id")).alias("entity"))
    extra = spark.createDataFrame([(None, "hot"), (5, None), (0, "hot"), (1, "e2")], "node bigint, entity string")
    got = {r.node: r.label for r in components(df.unionByName(extra)).collect()}
    assert got == {**{i: 0 for i in range(0, 3000, 3)}, 1: 1, 2: 1}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, "a"), (1, "a"), (2, "b")]) == {}
