"""Which records belong together: minimum labels over a bipartite graph of records and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Label every record with the smallest record id it reaches through shared entities.

    ``edges`` has ``node`` (bigint) and ``entity`` (any orderable type), one line for each
    entity of a record; lines with NULL in either say nothing and are left out, repeated
    lines change nothing. Returns ``node`` and ``label`` for the records that share at least
    one entity; every other record is its own component.

    A round gives each entity the smallest label among its records, each record the smallest
    among its entities, and then each record its label's label, so long chains shrink by
    doubling. Entities of one record are dropped first. Minima are taken map-side, so an
    entity that a third of all records share costs one line per partition; the join that
    sends its label back has one line for it on the small side, and AQE splits the other.
    Rounds end when the sum of labels, which can only fall, stays the same.
    """
    given = materialize(edges.select(F.col("node").cast("bigint").alias("node"), "entity").filter("node IS NOT NULL AND entity IS NOT NULL"), "given-edges")
    edges = given
    shared = edges.groupBy("entity").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("entity", F.col("lo").alias("m"))
    first = materialize(edges.join(shared, "entity"), "edges")
    forget(given)
    edges = first.select("node", "entity")
    labels, total = _written(first.groupBy("node").agg(F.min("m").alias("label")))
    for _ in range(MAX_ROUNDS):
        if total is None:
            break
        best = edges.join(labels, "node").groupBy("entity").agg(F.min("label").alias("m"))
        near = edges.join(best, "entity").groupBy("node").agg(F.min("m").alias("label"))
        near = materialize(near, "near")
        hop = near.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        before = total
        fresh, total = _written(near.join(hop, F.col("label") == F.col("via"), "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        forget(near)
        forget(labels)
        labels = fresh
        if total == before:
            break
    else:
        raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
    forget(first)
    return labels


def _written(labels: DataFrame):
    """The labels as a table, and their sum."""
    out = materialize(labels, "labels")
    return out, out.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
