"""What relates rows of the structure table: connectivity layer, structure text, ring skeleton."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.smiles import skeleton
from ..functions.text import connectivity, filled, layer_key, strip_ws
from ..session import materialize

#: Structure texts drawn by one task.
DRAWN_ROWS = 20_000


def layer_of_molregno(bioactivity: DataFrame) -> DataFrame:
    """``molregno`` and its ``layer``: the smallest filled connectivity of its activity rows."""
    return bioactivity.filter(F.col("molregno").isNotNull()).groupBy("molregno").agg(F.min(layer_key(F.col("inchikey_connectivity"))).alias("layer")).filter("layer IS NOT NULL")


def keyed(structures: DataFrame, bioactivity: DataFrame) -> DataFrame:
    """``molregno``, ``layer`` (own key, else that of the activity rows) and ``smiles`` (trimmed text); NULL where missing.

    Rows without molregno are left out.
    """
    rows = structures.filter(F.col("molregno").isNotNull()).select(
        "molregno", connectivity(F.col("standard_inchi_key")).alias("own"), F.when(~filled(F.col("standard_inchi_key")), F.col("molregno")).alias("seek"), F.when(filled(F.col("canonical_smiles")), strip_ws(F.col("canonical_smiles"))).alias("smiles")
    )
    other = layer_of_molregno(bioactivity).withColumnRenamed("molregno", "seek")
    return rows.join(other, "seek", "left").select("molregno", F.coalesce("own", "layer").alias("layer"), "smiles")


def edges(rows: DataFrame, rings: bool) -> DataFrame:
    """Record-entity lines of keyed rows: layer and structure text, with ``rings`` also the ring skeleton."""
    entities = [F.concat(F.lit("L:"), F.col("layer")), F.concat(F.lit("S:"), F.col("smiles"))]
    if rings:
        # Rows with one text are related by the text already, so only a text's first row needs its skeleton.
        first = rows.filter(F.col("smiles").isNotNull()).groupBy("smiles").agg(F.min("molregno").alias("node"))
        # Drawing is Python work on few bytes: spread it by rows, which size-based coalescing would not.
        first = first.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // DRAWN_ROWS))
        # Written once: a filter on the key would otherwise draw all rows again, below the grouping.
        drawn = materialize(first.select("node", F.concat(F.lit("R:"), skeleton(F.col("smiles"))).alias("entity")), "drawn")
    lines = rows.select(F.col("molregno").alias("node"), F.explode(F.array(*entities)).alias("entity"))
    return lines.unionByName(drawn) if rings else lines
