"""Structured Streaming over event files: an extension beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reserve

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet", schema: T.StructType = EVENTS) -> DataFrame:
    """A stream over the event files of a folder, with event time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and mean value per window and type; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def deduplicated(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a user that end after ``gap`` without events."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table and read it; state lives in the shared folder."""
    spark = stream.sparkSession
    path = reserve(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", reserve(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", reserve(spark, "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{path}/{last}")
