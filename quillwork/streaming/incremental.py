"""Incremental batch: resume, guarded ledgers, retry queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.identity import first_seen


def pending(work: DataFrame, done: DataFrame, key: str, retry: DataFrame | None = None) -> DataFrame:
    """Work not done yet, and what is to be tried again even if done. NULL keys are always pending."""
    rest = work.join(done.select(key), key, "left_anti")
    if retry is None:
        return rest
    again = work.join(done.select(key), key, "left_semi").join(retry.select(key), key, "left_semi")
    return rest.unionByName(again)


def append_new(ledger: DataFrame, entries: DataFrame, key: list[str], order: str) -> DataFrame:
    """Entries whose key the ledger lacks, the first along ``order`` of each new key."""
    one = first_seen(entries, [F.col(k) for k in key], [F.col(order)])
    return one.join(ledger.select(*key), key, "left_anti")


def merge_failures(old: DataFrame, new: DataFrame, succeeded: DataFrame, key: str, order: str) -> DataFrame:
    """The failure table after a run: the latest failure of each key (new beats old), without keys that succeeded."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    held = both.select(F.col(key).alias("_k"), F.struct("_run", order, F.struct(*both.columns).alias("row")).alias("s")).groupBy("_k").agg(F.max("s").alias("s"))
    return held.select("s.row.*").drop("_run").join(succeeded.select(key), key, "left_anti")
