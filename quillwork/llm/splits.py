"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.balance import place
from ..session import materialize
from . import compounds
from .components import components

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

def related(structures: DataFrame, bioactivity: DataFrame) -> DataFrame:
    """``molregno`` and ``component``: rows related by layer, structure text or ring skeleton, also through other rows.

    Every row with a molregno comes out; a row related to none is its own component.
    """
    keyed = materialize(compounds.keyed(structures, bioactivity), "keyed")
    labels = components(compounds.edges(keyed, rings=True))
    return keyed.select("molregno").join(labels, F.col("molregno") == F.col("node"), "left").select("molregno", F.coalesce("label", "molregno").alias("component"))


def assign(records: DataFrame, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Give each component one split: ``component``, ``split``, ``n``.

    ``records`` has ``component`` and ``label`` (the stratum; NULL is a label of its own), at
    most 64 labels. Components of every size are placed by one rule (``balance.place``), the
    largest first, so that label counts deviate least from the splits' targets. Proportions
    hold as far as a component that is larger than a split's whole share allows. Empty input
    gives no lines.
    """
    names = list(shares)
    parts = place(records, "component", "label", [shares[s] for s in names], seed)
    return parts.select("component", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1).alias("split"), "n")


def split_name(c):
    """train, validation or test by the first two letters, case and outer white space aside; else NULL."""
    head = F.substring(F.lower(strip_ws(c)), 1, 2)
    return F.when(head == "tr", "train").when(head == "va", "validation").when(head == "te", "test")


def torn(assigned: DataFrame, component: DataFrame) -> DataFrame:
    """Records of components that span more than one split.

    ``assigned``: molregno, split_name, assigned_at; the latest line counts (on ties the
    greatest name, a NULL name is least). Molecules whose latest split is NULL or unreadable
    take no part. ``component``: molregno, component. Molecules outside it are related to none.
    """
    latest = assigned.filter("molregno IS NOT NULL").groupBy("molregno").agg(F.max(F.struct("assigned_at", "split_name")).alias("a"))
    held = materialize(latest.select("molregno", split_name(F.col("a.split_name")).alias("split")).filter("split IS NOT NULL").join(component, "molregno"), "held")
    mixed = held.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo < hi").select("component")
    return held.join(mixed, "component", "left_semi").select("molregno", "component", "split")
