"""Work on structure texts, done once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, strip_ws
from ..session import materialize

#: Texts drawn by one task.
DRAWN_ROWS = 20_000


def spread(texts: DataFrame, n: int) -> DataFrame:
    """Rows by number over enough tasks: reading a structure is Python work on few bytes, which size-based coalescing would leave to one task."""
    return texts.repartition(max(2 * texts.sparkSession.sparkContext.defaultParallelism, n // DRAWN_ROWS))


def by_text(rows: DataFrame, text: str, make: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds ``make`` of the trimmed structure text as column ``name``; NULL where the text is not filled.

    Each distinct text is read once, whatever the number of its rows, and the results are
    written, so that no later filter reads them again. A text that a third of all rows share
    is one line of the side that is sent back.
    """
    key = F.when(filled(F.col(text)), strip_ws(F.col(text)))
    texts = materialize(rows.select(key.alias("_t")).filter("_t IS NOT NULL").distinct(), "texts")
    made = materialize(spread(texts, texts.count()).select("_t", make(F.col("_t")).alias(name)), "drawn")
    return rows.withColumn("_t", key).join(made, "_t", "left").drop("_t")
