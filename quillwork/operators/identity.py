"""Row identity: stable numbers, first-seen rows, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_total


def with_row_id(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Adds 1-based row numbers along a unique order, by range partitions and offsets instead of one sorted task.

    NULL orders come last. Repeated orders get numbers in no stated sequence.
    """
    out = running_total(df.withColumn("_one", F.lit(1)), order, "_one")
    return out.select(*df.columns, (F.col("before") + 1).cast("bigint").alias(name))


def first_seen(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key along a total order.

    A map-side minimum of (order, row) per key: a hot key costs one row a partition, no window.
    NULL keys form one group; ties in the order take the smallest row.
    """
    held = df.select(*(k.alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("_row")).alias("_s"))
    return held.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min("_s").alias("_s")).select("_s._row.*")


def record_id(*fields: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the fields joined by U+001E; NULL counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1e", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256), 1, length)


def content_hash(df: DataFrame, line: Column, buckets: int = 4096) -> DataFrame:
    """One row: a hash of all lines that their order does not change.

    Lines are hashed into buckets by their SHA-256, each bucket's sorted hashes are hashed, then
    the sorted bucket hashes: no task sees the whole table. A repeated line counts each time.
    """
    h = F.sha2(F.coalesce(line, F.lit("\x00")), 256)
    one = df.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    part = one.groupBy(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint").__mod__(buckets).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "h", F.col("n").cast("string")))), "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("b").cast("string"), "h"))), "\n"), 256).alias("content_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))
