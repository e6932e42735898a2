"""Grouped cross-validation, forests, principal components: Spark ML with group-aware folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balance import place
from .metrics import auroc, average_precision


def group_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` (0 to k - 1): groups stay together, folds have like class counts.

    Groups of every size are placed by one rule (``balance.place``). NULL groups are one
    group; a label other than 1 is the negative class.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("\x00"))
    keyed = rows.withColumn("_g", g)
    folds = place(keyed.select("_g", F.coalesce(F.col(label) == 1, F.lit(False)).alias("_l")), "_g", "_l", [1.0 / k] * k, seed)
    return keyed.join(folds.select("_g", F.col("part").alias("fold")), "_g").drop("_g")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (2 n of the class)."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = rows.agg(F.count(F.lit(1)).alias("_t"))
    return rows.join(c, label).crossJoin(t).withColumn("weight", F.col("_t") / (2.0 * F.col("_c"))).drop("_c", "_t")


def forest_cv(rows: DataFrame, features: list[str], label: str, group: str, grid: list[dict], k: int = 5, seed: int = 42) -> DataFrame:
    """Mean AUROC and average precision of each grid point over grouped folds: ``point``, ``auroc``, ``average_precision``, ``chosen`` (best mean average precision, the first on ties), ``n_invalid``.

    Rows with a NULL or NaN feature or a NULL label are in no fold; ``n_invalid`` counts them.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..session import materialize

    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.filter(F.col(label).isNotNull()))
    data = group_folds(data, group, label, k, seed)
    data = materialize(class_weights(data.select("_x", F.col(label).cast("double").alias("_y"), "fold"), "_y"), "folds")
    n_invalid = rows.count() - data.count()
    parts = rows.sparkSession.sparkContext.defaultParallelism  # a small table is one partition, deep trees are much work
    out = []
    for i, point in enumerate(grid):
        scores = []
        for f in range(k):
            train = data.filter(F.col("fold") != f).repartition(parts).persist()  # a fit of deep trees reads it often
            model = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", seed=seed, cacheNodeIds=True, **point).fit(train)
            train.unpersist()
            s = model.transform(data.filter(F.col("fold") == f)).select("_y", F.round(vector_to_array("probability")[1], 9).alias("s"))
            s = materialize(s, "scores")
            a, p = auroc(s, "s", "_y").first()["auroc"], average_precision(s, "s", "_y").first()["average_precision"]
            if a is not None and p is not None:
                scores.append((a, p))
        mean = np.mean(scores, axis=0) if scores else (float("nan"), float("nan"))
        out.append((i, str(point), float(mean[0]), float(mean[1])))
    best = max(range(len(out)), key=lambda i: (out[i][3], -i))
    return rows.sparkSession.createDataFrame([(*o, i == best, n_invalid) for i, o in enumerate(out)], "point int, parameters string, auroc double, average_precision double, chosen boolean, n_invalid bigint")


def first_best(points: DataFrame, point: str, score: str) -> DataFrame:
    """Adds ``chosen``: of the points with the highest score the first. NULL and NaN scores are never chosen."""
    usable = points.filter(F.col(score).isNotNull() & ~F.isnan(score))
    best = usable.agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(point).alias("p"))).alias("_b"))  # one line
    return points.crossJoin(best).withColumn("chosen", F.coalesce(F.col(point) == F.col("_b.p"), F.lit(False))).drop("_b")


def principal_components(rows: DataFrame, vec: str, k: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores on the first k principal components of standardised vectors (signs: the largest loading is positive)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = rows.filter(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))
    d = d.select(*keep, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_x"))
    s = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(d).transform(d)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(s)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), range(k)])
    p = vector_to_array("_p")
    return model.transform(s).select(*keep, *((p[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)))
