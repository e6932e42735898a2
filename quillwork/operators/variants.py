"""Names that stand for one thing: groups of spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import SAME_STEM, all_alike, lead_word, stereo_free

#: Stems that are compared in one call.
CHUNK = 128


def variant_groups(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``group``, ``n_names`` and ``kind`` of every group with two names or more.

    ``kind`` is ``one`` if the names have one stereo-free stem, or one leading word, or if the
    least similar two stems match in SAME_STEM of their letters; else ``several``. Most groups
    are told by minima and maxima alone: of stems, of leading words, of stem lengths (two
    stems cannot match in more letters than the shorter has). What is left is compared in
    chunks of stems, so that no call and no row holds a whole group. Rows with a NULL group or
    name are left out.
    """
    names = rows.filter(F.col(group).isNotNull() & F.col(name).isNotNull()).select(F.col(group).alias("_g"), F.col(name).alias("_n")).distinct()
    keyed = names.select("_g", "_n", F.coalesce(stereo_free(F.col("_n")), F.lit("")).alias("stem"), lead_word(F.col("_n")).alias("lead"))
    size = F.length("stem")
    told = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n_names"), F.min("stem").alias("s0"), F.max("stem").alias("s1"), F.min("lead").alias("l0"), F.max("lead").alias("l1"), F.min(size).alias("short"), F.max(size).alias("long")).filter("n_names > 1")
    kind = F.when((F.col("s0") == F.col("s1")) | (F.col("l0") == F.col("l1")), "one").when(2 * F.col("short") < SAME_STEM * (F.col("short") + F.col("long")), "several")
    told = told.select("_g", "n_names", kind.alias("kind"))
    open_groups = told.filter("kind IS NULL").select("_g", F.ceil(F.col("n_names") / CHUNK).cast("int").alias("parts"))
    chunks = keyed.select("_g", "stem").distinct().join(open_groups, "_g").groupBy("_g", F.pmod(F.xxhash64("stem"), F.col("parts")).alias("c")).agg(F.collect_list("stem").alias("stems"))
    other = chunks.select("_g", F.col("c").alias("d"), F.col("stems").alias("others"))
    met = chunks.join(other, "_g").filter("c <= d").select("_g", all_alike("stems", "others").alias("alike"))
    verdict = met.groupBy("_g").agg(F.bool_and("alike").alias("alike"))
    out = told.join(verdict, "_g", "left").withColumn("kind", F.coalesce("kind", F.when(F.col("alike"), "one").otherwise("several")))
    return out.select(F.col("_g").alias(group), F.col("n_names").cast("bigint").alias("n_names"), "kind")
