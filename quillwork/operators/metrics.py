"""Scores of predictions: rank metrics, calibration, cut-offs, enrichment, bootstrap intervals.

All of them work on distinct scores with their counts: one aggregation with map-side combine,
then running totals by ranges; no task sorts the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget, materialize
from .prefix import running_total


def score_counts(df: DataFrame, score: str, label: str, within: list[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score; rows with NULL score or label are out."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(*within, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))


def auroc(df: DataFrame, score: str, label: str, within: list[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; NULL unless both classes occur."""
    c = running_total(score_counts(df, score, label, list(within)), "s", "neg", list(within))
    g = c.groupBy(*within).agg(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*within, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, within: list[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores; NULL without positives."""
    c = score_counts(df, score, label, list(within)).withColumn("both", F.col("pos") + F.col("neg"))
    b = running_total(c, "s", {"tp0": "pos", "before": "both"}, list(within), descending=True)
    step = F.col("pos") * (F.col("tp0") + F.col("pos")) / (F.col("before") + F.col("both"))
    return b.groupBy(*within).agg(F.sum(step).alias("x"), F.sum("pos").alias("n_pos")).select(*within, "n_pos", F.when(F.col("n_pos") > 0, F.col("x") / F.col("n_pos")).alias("average_precision"))


def brier(df: DataFrame, score: str, label: str, within: list[str] = ()) -> DataFrame:
    """Mean squared distance of score and label."""
    return df.groupBy(*within).agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


#: The doubles that ten equal steps from 0 to 1 give.
CALIBRATION_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def calibration(df: DataFrame, score: str, label: str) -> DataFrame:
    """Ten bins, the last closed; an empty bin has its midpoint as mean score and rate 0. Scores outside 0 to 1 are out."""
    e = CALIBRATION_EDGES
    b = F.lit(0)
    for i in range(1, 10):
        b = F.when(F.col(score) >= e[i], F.lit(i)).otherwise(b)
    g = df.filter((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_pos"), F.avg(score).alias("m"), F.avg(label).alias("r"))
    bins = df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(10)], "bin int, low double, high double")
    return bins.join(g, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("m", (F.col("low") + F.col("high")) / 2).alias("mean_score"), F.coalesce("r", F.lit(0.0)).alias("rate"))


def best_f1(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """The threshold with the highest F1, the first on ties.

    Rows are counted by score and then by how many thresholds that reaches, map-side; suffix sums over those few
    counts give every threshold's confusion. NULL scores reach none. Thresholds ascend.
    """
    steps = F.array(*(F.lit(float(x)) for x in thresholds))
    reach = F.coalesce(F.size(F.filter(steps, lambda x: x <= F.col(score))), F.lit(0))
    y = F.col(label) == 1
    each = df.groupBy(score).agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(y, 1).otherwise(0)).alias("tp"))
    counts = each.groupBy(F.greatest(reach, F.lit(0)).alias("r")).agg(F.sum("k").alias("k"), F.sum("tp").alias("tp"))
    every = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(thresholds)], "i int, threshold double")
    total = counts.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("p"))
    at = every.join(counts, F.col("r") > F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp")).crossJoin(total)  # thresholds by thresholds
    f1 = F.when(F.col("k") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("k") + F.col("p"))).otherwise(0.0)
    return at.select("threshold", f1.alias("f1"), "i").orderBy(F.desc("f1"), "i").limit(1).drop("i")


def enrichment(df: DataFrame, score: str, label: str, shares: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """For each share of the ranking: rows in it, positives found, recovery and enrichment over chance. Ties enter together."""
    c = score_counts(df, score, label).withColumn("both", F.col("pos") + F.col("neg"))
    r = running_total(c, "s", "both", descending=True)
    total = c.agg(F.sum("both").alias("n"), F.sum("pos").alias("p"))
    r = r.crossJoin(total)
    out = r.agg(F.first("n").alias("n"), F.first("p").alias("p"), *(F.sum(F.when(F.col("before") < F.ceil(F.col("n") * x), F.col("pos")).otherwise(0)).alias(f"f{i}") for i, x in enumerate(shares)))
    lines = F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"f{i}").alias("found")) for i, x in enumerate(shares)))
    recovery = F.when(F.col("p") > 0, F.col("l.found") / F.col("p"))
    return out.select("n", "p", F.explode(lines).alias("l")).select("l.share", "n", F.col("p").alias("n_pos"), "l.found", recovery.alias("recovery"), (recovery / F.col("l.share")).alias("enrichment"))


def uniform(seed: int, row: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for every row hash (down) and draw (across); they depend on nothing else."""
    with np.errstate(over="ignore"):
        x = row.astype("int64").view("uint64")[:, None] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = x + (draw.astype("uint64")[None, :] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


#: The distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = np.array((0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253))
#: Rows by draws of a block of drawn numbers.
DRAWN = 2_000_000


def drawn_sums(df: DataFrame, columns: list[str], n: int, seed: int, within: list[str], weigh) -> DataFrame:
    """``within``, ``draw`` and the sums of ``columns``, each row weighted anew in every one of ``n`` draws.

    ``df`` has a row hash ``_h`` and ``columns`` as doubles without NULLs. ``weigh`` turns drawn
    uniform numbers into weights. A partition sums its rows itself, in blocks of a matrix
    product, and gives one line for each of ``within`` (more where it holds very many of
    them), so rows are never multiplied by draws.
    """
    schema = T.StructType([df.schema[c] for c in within] + [T.StructField("_sums", T.ArrayType(T.ArrayType(T.DoubleType())))])
    draws, most = np.arange(n), max(1, DRAWN // n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush():
            out = pd.DataFrame([[*k, [list(r) for r in v]] for k, v in held.items()], columns=[*within, "_sums"])
            held.clear()
            return out

        for pdf in batches:
            groups = pdf.groupby(within, dropna=False, sort=False).indices.items() if within else [((), np.arange(len(pdf)))]
            h, x = pdf["_h"].to_numpy("int64"), pdf[columns].to_numpy(float)
            for k, rows in groups:
                k = k if isinstance(k, tuple) else (k,)
                total = held.setdefault(k, np.zeros((len(columns), n)))
                for a in range(0, len(rows), most):
                    at = rows[a : a + most]
                    total += x[at].T @ weigh(uniform(seed, h[at], draws))
            if len(held) * n * len(columns) > DRAWN:
                yield flush()
        if held:
            yield flush()

    lines = df.select(*within, "_h", *columns).mapInPandas(run, schema)
    each = lines.select(*within, F.posexplode(F.arrays_zip(*(F.col("_sums")[i].alias(c) for i, c in enumerate(columns)))).alias("draw", "s"))
    return each.groupBy(*within, "draw").agg(*(F.sum(F.col("s")[c]).alias(c) for c in columns))


def bootstrap(df: DataFrame, means: dict[str, tuple[str, str | None]], n: int = 1000, seed: int = 42, within: list[str] = ()) -> DataFrame:
    """95 percent percentile intervals of means (``name: (value, label to filter by or None)``).

    Rows get Poisson counts from hashes of their ids, so a draw depends on the rows alone and
    not on where they lie. NULL values are out.
    """
    ids = [c for c in df.columns if c.endswith("_id") or c.endswith("key")] or df.columns
    cols, parts = [], []
    for i, (v, c) in enumerate(means.values()):
        counts = F.col(v).isNotNull() & (F.coalesce(F.col(c), F.lit(False)) if c else F.lit(True))
        parts += [F.when(counts, F.col(v).cast("double")).otherwise(0.0).alias(f"_v{i}"), F.when(counts, 1.0).otherwise(0.0).alias(f"_c{i}")]
        cols += [f"_v{i}", f"_c{i}"]
    rows = df.select(*within, F.xxhash64(*ids).alias("_h"), *parts)
    sums = drawn_sums(rows, cols, n, seed, list(within), lambda u: np.searchsorted(POISSON, u, side="left").astype(float))
    per = sums.select(*within, "draw", *(F.when(F.col(f"_c{i}") > 0, F.col(f"_v{i}") / F.col(f"_c{i}")).alias(name) for i, name in enumerate(means)))
    return per.groupBy(*within).agg(F.count(F.lit(1)).alias("n_draws"), *(x for name in means for x in (F.percentile(name, F.lit(0.025)).alias(f"{name}_lo"), F.percentile(name, F.lit(0.975)).alias(f"{name}_hi"))))  # n values a group


#: Distinct scores whose resampled counts are held at a time.
SCORE_CHUNK = 1_000


def _resampled(pdf: pd.DataFrame, n: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores from the highest down, with the positives and negatives at each in every one of ``n`` resamples.

    The sum of k independent Poisson(1) counts is a Poisson(k) count, so one draw stands for all rows of a score and label.
    """
    pdf = pdf.sort_values("s", ascending=False, na_position="first")
    for at in range(0, len(pdf), SCORE_CHUNK):
        part = pdf.iloc[at : at + SCORE_CHUNK]
        pos, neg = np.empty((len(part), n)), np.empty((len(part), n))
        for i, (h, p, m) in enumerate(zip(part["h"].to_numpy("int64").view("uint64"), part["pos"], part["neg"])):
            rng = np.random.Generator(np.random.Philox(key=np.array([seed, h], "uint64")))
            pos[i], neg[i] = rng.poisson(p, n), rng.poisson(m, n)
        yield part["s"].to_numpy(float), pos, neg


def bootstrap_ranking(df: DataFrame, score: str, label: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """AUROC, average precision and Brier score, each with its 95 percent percentile interval over ``n`` resamples.

    Resamples of a single class are skipped; ``n_draws`` counts the others, and without any the
    intervals are NULL. Counts by score are range partitioned from the highest score down;
    every partition adds its part of all resamples, so only sums of partitions reach the driver.
    Rows with NULL score or label are out.
    """
    spark = df.sparkSession
    lines = score_counts(df, score, label).withColumn("s", F.col("s").cast("double")).withColumn("h", F.xxhash64("s"))
    laid = materialize(lines.repartitionByRange(max(2, spark.sparkContext.defaultParallelism), F.col("s").desc()).withColumn("pid", F.spark_partition_id()), "scores")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, neg = np.zeros(n), np.zeros(n)
        for _, p, m in _resampled(pdf, n, seed):
            pos += p.sum(0)
            neg += m.sum(0)
        return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "pos": [pos], "neg": [neg]})

    sums = sorted(laid.groupBy("pid").applyInPandas(totals, "pid int, pos array<double>, neg array<double>").collect())  # one line a partition
    start, tp, fp = {}, np.zeros(n), np.zeros(n)
    for r in sums:
        start[r["pid"]] = (tp, fp)
        tp, fp = tp + np.array(r["pos"]), fp + np.array(r["neg"])
    before = spark.sparkContext.broadcast(start)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        tp, fp = before.value[pdf["pid"].iloc[0]]
        wins, steps, squares = np.zeros(n), np.zeros(n), np.zeros(n)
        for s, p, m in _resampled(pdf, n, seed):
            tps, fps = tp + p.cumsum(0), fp + m.cumsum(0)
            wins += (m * (tps - p / 2)).sum(0)
            steps += (p * tps / np.maximum(tps + fps, 1)).sum(0)
            squares += ((1 - s[:, None]) ** 2 * p + s[:, None] ** 2 * m).sum(0)
            tp, fp = tps[-1], fps[-1]
        return pd.DataFrame({"wins": [wins], "steps": [steps], "squares": [squares]})

    rows = laid.groupBy("pid").applyInPandas(parts, "wins array<double>, steps array<double>, squares array<double>").collect()
    both = (tp > 0) & (fp > 0)
    wins, steps, squares = (np.sum([r[c] for r in rows], axis=0)[both] if rows else np.zeros(0) for c in ("wins", "steps", "squares"))
    tp, fp = tp[both], fp[both]
    forget(laid)
    seen = {
        "auroc": (auroc(df, score, label).first()["auroc"], wins / (tp * fp)),
        "average_precision": (average_precision(df, score, label).first()["average_precision"], steps / tp),
        "brier": (brier(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()), score, label).first()["brier"], squares / (tp + fp)),
    }
    out, kinds = [int(both.sum())], ["n_draws bigint"]
    for name, (value, draws) in seen.items():
        out += [value, *(map(float, np.percentile(draws, [2.5, 97.5])) if len(draws) else (None, None))]
        kinds += [f"{name} double", f"{name}_lo double", f"{name}_hi double"]
    return spark.createDataFrame([tuple(out)], ", ".join(kinds))
