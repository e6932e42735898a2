"""Percentiles of very many values per key, with bounded rank error, that can be combined later.

Method: deterministic buffer collapsing. A summary is a set of weighted values per key. Where
a key has more than ``k`` of them they are sorted and ``k`` evenly spaced positions of the
weighted sequence are kept, each with an equal share of the weight; where it has no more,
all are kept and nothing is lost. Summaries merge by collapsing their union.

A collapse of total weight W moves no rank by more than W / 2k, whatever the order and the
weights of its input. So a key's rank error is at most the sum of W / 2k over the collapses
behind its summary. That sum is carried along in the column ``err`` and comes out beside the
percentiles: the bound is not assumed, it is counted.

Tree scheduling keeps the sum small. Buffers of one level wait in a Tower until FAN of them
can collapse into one of the next level, so a value goes through about log(chunks) collapses
and not through one for each chunk that follows it. Input partitions build their own towers
without a shuffle; then groups of FAN_IN partial summaries of a key meet until one is left.
With ``h`` levels in all the bound is ``h / 2k``: a partition of 10 million values of one key
takes 4 (chunk, two tower levels, closing), 100,000 partitions 3 times at most 4 more, which
is 16 / 2048 = 0.8 percent at the k below. No task holds more of a key than
FAN * levels * k values at a time, however many rows the key has.

Summaries are flat lines (keys, value, weight, err): numpy works on whole Arrow batches, keys
are never looped over in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

K = 1024
#: Partial summaries of a key that meet in one task of the tree.
FAN_IN = 64
#: Buffers of one level that collapse into one of the next.
FAN = 8
#: Rows an input partition holds at a time before it collapses them.
CHUNK = 400_000


def collapse(group: np.ndarray, value: np.ndarray, weight: np.ndarray, err: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reduce every group of more than ``k`` weighted values to ``k``; groups are small integers.

    Values come out sorted within their group, which keeps its total weight. The errors of a
    group add up; a reduced one has them on its first line, with what the reduction adds.
    """
    order = np.lexsort((value, group))
    group, value, weight, err = group[order], value[order], weight[order], err[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(group)])
    big = size > k
    if not big.any():
        return group, value, weight, err
    total, errs = np.add.reduceat(weight, start), np.add.reduceat(err, start)
    keep = ~np.repeat(big, size)
    out = [[group[keep]], [value[keep]], [weight[keep]], [err[keep]]]
    for b in np.flatnonzero(big):  # at most rows / k of them
        s = slice(start[b], start[b] + size[b])
        at = np.searchsorted(np.cumsum(weight[s]), (np.arange(k) + 0.5) * (total[b] / k))
        moved = np.zeros(k)
        moved[0] = errs[b] + total[b] / (2 * k)
        for column, part in zip(out, (np.full(k, group[start[b]]), value[s][np.minimum(at, size[b] - 1)], np.full(k, total[b] / k), moved)):
            column.append(part)
    return tuple(np.concatenate(column) for column in out)


def _reduce(pdf: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    codes = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    first = pdf[keys].to_numpy(dtype=object)[np.unique(codes, return_index=True)[1]] if len(pdf) else np.zeros((0, len(keys)), object)
    g, v, w, e = collapse(codes, pdf["value"].to_numpy(float), pdf["weight"].to_numpy(float), pdf["err"].to_numpy(float), k)
    out = pd.DataFrame(first[g], columns=keys)
    out["value"], out["weight"], out["err"] = v, w, e
    return out


class Tower:
    """Buffers by level: FAN of a level are reduced to one of the next, so all weights that meet are alike."""

    def __init__(self, reduce):
        self.reduce, self.levels = reduce, []

    def add(self, frame: pd.DataFrame) -> pd.DataFrame | None:
        """Take a buffer of level 0 (reduced). Returns lines that hardly collapse and need not wait here, else None."""
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(frame)
            if len(self.levels[level]) < FAN:
                return None
            union = pd.concat(self.levels[level], ignore_index=True)
            self.levels[level] = []
            frame = self.reduce(union)
            if len(frame) > len(union) // 2:
                return frame
            level += 1

    def close(self) -> pd.DataFrame | None:
        """All that is left, reduced once more."""
        rest = [f for level in self.levels for f in level]
        self.levels = []
        return self.reduce(pd.concat(rest, ignore_index=True)) if len(rest) > 1 else rest[0] if rest else None


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[x] for x in keys] + [T.StructField(x, T.DoubleType()) for x in ("value", "weight", "err")])


def summarise(values: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Summary lines (keys, value, weight, err) of a frame with ``keys`` and ``value``.

    NULL and NaN values are left out; a NULL key is a key. Other columns are ignored.
    """
    rows = values.select(*keys, F.col("value").cast("double").alias("value"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("err")).filter(F.col("value").isNotNull() & ~F.isnan("value"))

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tower, held, n = Tower(lambda pdf: _reduce(pdf, keys, k)), [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                one = tower.reduce(pd.concat(held, ignore_index=True))
                wide = one if len(one) > n // 2 else tower.add(one)  # nothing much to collapse: pass it on
                if wide is not None:
                    yield wide
                held, n = [], 0
        last = tower.reduce(pd.concat(held, ignore_index=True)) if n else None
        wide = tower.add(last) if last is not None else None
        for rest in (wide, tower.close()):
            if rest is not None and len(rest):
                yield rest

    # Written, so that the tree is laid over the partitions there really are.
    part = rows.mapInPandas(leaf, _schema(rows, keys)).withColumn("part", F.spark_partition_id())
    part = materialize(part, "leaves")
    leaves = (part.agg(F.max("part")).first()[0] or 0) + 1
    while leaves > FAN_IN:
        part = part.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        part = merge(part, [*keys, "part"], k)
        leaves = -(-leaves // FAN_IN)
    return merge(part, keys, k)


def merge(summary: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Summaries combined to one for each of ``keys`` (a subset of theirs)."""
    return _by_key(summary, keys, _schema(summary, keys), lambda pdf: _reduce(pdf, keys, k), FAN_IN * k)


def percentiles(summary: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Values at the given ranks for each key, with ``n``, the number of values behind them, and ``rank_error``.

    ``rank_error`` is the proven bound, as a share of ``n``: the value at ``p`` stands at a rank
    within it of ``p * n``. 0 means that the values are exact: then the value at ``p`` is the
    first whose rank reaches ``p * n`` (at least the first value). Column names are ``p10`` for 0.1 and so on; empty summaries give no lines.
    """
    names = [name_of(p) for p in probs]
    schema = T.StructType([summary.schema[x] for x in keys] + [T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())] + [T.StructField(x, T.DoubleType()) for x in names])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = pdf[keys].to_numpy(dtype=object)[np.unique(codes, return_index=True)[1]]
        order = np.lexsort((pdf["value"].to_numpy(), codes))
        g, v, w = codes[order], pdf["value"].to_numpy(float)[order], pdf["weight"].to_numpy(float)[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        last = np.r_[start[1:], len(g)] - 1
        total = np.add.reduceat(w, start)
        run = np.cumsum(w)
        before = run[start] - w[start]
        out = pd.DataFrame(first, columns=keys)
        out["n"] = np.rint(total).astype("int64")
        out["rank_error"] = np.add.reduceat(pdf["err"].to_numpy(float)[order], start) / total
        for p, name in zip(probs, names):
            at = np.searchsorted(run, before + p * total - 1e-7 * np.maximum(1.0, total))
            out[name] = v[np.clip(at, start, last)]
        return out

    return _by_key(summary, keys, schema, finish)


def name_of(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def _by_key(df: DataFrame, keys: list[str], schema: T.StructType, reduce, most: int | None = None) -> DataFrame:
    """Bring each key together and hand whole keys to ``reduce``, many at a time.

    With ``most``, lines of one key beyond that many are reduced on the way in a tower of
    their own, so that a key of any number of summaries fits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tower = None, None  # the lines of the last key, not yet in its tower; the tower, once it has one

        def whole(lines: pd.DataFrame) -> pd.DataFrame:
            # ``most`` lines and more of one key: always collapses to k, so nothing passes through the tower
            rest = [lines] if tower is None else [f for f in (tower.close(), lines) if f is not None and len(f)]
            return reduce(pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0])

        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            end = pdf[keys].iloc[-1]
            same = np.ones(len(pdf), bool)
            for c in keys:
                same &= pdf[c].isna().to_numpy() if pd.isna(end[c]) else (pdf[c] == end[c]).fillna(False).to_numpy(bool)
            cut = int(np.flatnonzero(same)[0])  # keys are sorted, so the last one's lines are at the end
            if cut:
                if tower is not None:  # the first key of these is the one the tower belongs to
                    first = pdf[keys].iloc[0]
                    old = np.ones(cut, bool)
                    for c in keys:
                        head = pdf[c].iloc[:cut]
                        old &= head.isna().to_numpy() if pd.isna(first[c]) else (head == first[c]).fillna(False).to_numpy(bool)
                    n_old = int(old.sum())
                    yield whole(pdf.iloc[:n_old].reset_index(drop=True))
                    tower = None
                    if n_old < cut:
                        yield reduce(pdf.iloc[n_old:cut].reset_index(drop=True))
                else:
                    yield reduce(pdf.iloc[:cut].reset_index(drop=True))
            held = pdf.iloc[cut:].reset_index(drop=True)
            if most is not None and len(held) > most:
                tower = tower or Tower(reduce)
                # a line of the key stays behind, so that its end is seen
                tower.add(reduce(held.iloc[1:].reset_index(drop=True)))
                held = held.iloc[:1]
        if held is not None and len(held):
            yield whole(held)

    return df.select(*keys, "value", "weight", "err").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
