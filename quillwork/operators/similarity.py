"""Set and structure similarity: nearest neighbours by Tanimoto, optimal assignment, pose comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: References that one broadcast holds; a larger reference set is met in as many passes as it needs.
BLOCK_ROWS = 50_000


def sign_bits(vec: Column) -> Column:
    """On-bits of a vector: the positions (from 0) of its positive members. NULL stays NULL, NaN is off."""
    return F.filter(F.transform(vec, lambda x, i: F.when((x > 0) & ~F.isnan(x), i)), lambda i: i.isNotNull())


def _pack(bits: list, width: int) -> np.ndarray:
    out = np.zeros((len(bits), width), np.uint8)
    for r, b in enumerate(bits):
        out[r, np.asarray(b, int)] = 1
    return np.packbits(out, axis=1)


#: Tile of a search: queries by references.
TILE_Q, TILE_R = 1_024, 4_096


def _best_of(mine: np.ndarray, packed: np.ndarray, width: int, own: list[list[int]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Position and similarity of the best reference of each query, the first on ties; ``own`` are positions a query must not take."""
    best, sim = np.zeros(len(mine), int), np.full(len(mine), -1.0)
    for b in range(0, len(packed), TILE_R):
        right = np.unpackbits(packed[b : b + TILE_R], axis=1, count=width).astype(np.float32)
        n_ref = right.sum(1, dtype=float)
        for a in range(0, len(mine), TILE_Q):
            left = np.unpackbits(mine[a : a + TILE_Q], axis=1, count=width).astype(np.float32)
            both = (left @ right.T).astype(float)  # whole numbers, exact
            either = left.sum(1, dtype=float)[:, None] + n_ref[None, :] - both
            s = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
            if own is not None:
                for i, positions in enumerate(own[a : a + TILE_Q]):
                    for p in positions:
                        if b <= p < b + len(right):
                            s[i, p - b] = -1.0
            at = s.argmax(1)
            top = s[np.arange(len(s)), at]
            more = top > sim[a : a + TILE_Q]
            best[a : a + TILE_Q][more] = at[more] + b
            sim[a : a + TILE_Q][more] = top[more]
    return best, sim


def nearest(queries: DataFrame, references: DataFrame, width: int, key: str = "id", bits: str = "bits", label: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The most similar reference of each query by Tanimoto on on-bit arrays: ``key``, ``nearest``, ``similarity`` and the reference's ``label``.

    On ties the smallest reference key. Two empty sets have similarity 0. References come in
    blocks of BLOCK_ROWS; each block is sent to the queries once and the best of the blocks
    is kept, so the broadcast is bounded for any number of references. Rows with NULL bits or
    key take no part; without references there are no lines.
    """
    spark = queries.sparkSession
    q = queries.filter(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(key, bits)
    r = references.filter(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(F.col(key).alias("_k"), F.col(bits).alias("_b"), *([F.col(label).cast("double").alias("_y")] if label else [F.lit(None).cast("double").alias("_y")]))
    blocks = max(1, -(-r.count() // BLOCK_ROWS))
    if blocks > 1:
        r = materialize(r.withColumn("_g", F.pmod(F.xxhash64("_k"), F.lit(blocks))), "references")
    schema = T.StructType([q.schema[key], T.StructField("nearest", r.schema["_k"].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = (r.filter(F.col("_g") == b) if blocks > 1 else r).orderBy("_k").collect()  # one block
        if not part:
            continue
        held = spark.sparkContext.broadcast(([x["_k"] for x in part], _pack([x["_b"] for x in part], width), np.array([np.nan if x["_y"] is None else x["_y"] for x in part])))

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            keys, packed, y = held.value
            names = np.array(keys, dtype=object)
            where: dict = {}
            if exclude_self:
                for p, k in enumerate(keys):
                    where.setdefault(k, []).append(p)
            for pdf in batches:
                if not len(pdf):
                    continue
                own = [where.get(k, ()) for k in pdf[key].tolist()] if exclude_self else None
                best, sim = _best_of(_pack(pdf[bits].tolist(), width), packed, width, own)
                res = pd.DataFrame({key: pdf[key], "nearest": names[best], "similarity": sim, "label": y[best]})
                yield res[res["similarity"] >= 0]

        one = q.mapInPandas(search, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    if blocks > 1:
        top = out.groupBy(key).agg(F.max("similarity").alias("similarity"))
        out = out.join(top, [key, "similarity"]).groupBy(key).agg(F.min_by(F.struct("nearest", "similarity", "label"), "nearest").alias("m")).select(key, "m.*")
    return out.withColumn("label", F.nanvl("label", F.lit(None).cast("double")))


def assign_least(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Column of each row in the cheapest one-to-one assignment, and its cost; rows must not exceed columns.

    Shortest augmenting paths with potentials, one row at a time.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    owner = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for row in range(n):
        dist = cost[row] - u[row] - v
        via = np.full(m, -1)
        done = np.zeros(m, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            through = dist[j] + cost[i] - u[i] - v
            closer = ~done & (through < dist)
            dist[closer], via[closer] = through[closer], j
        reach = dist[j]
        for k in np.flatnonzero(done):
            if k != j:
                u[owner[k]] += reach - dist[k]
                v[k] -= reach - dist[k]
        u[row] += reach
        while via[j] >= 0:
            owner[j] = owner[via[j]]
            j = via[j]
        owner[j] = row
    col = np.empty(n, int)
    col[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return col, float(cost[np.arange(n), col].sum())


@F.pandas_udf(T.DoubleType())
def pose_rmsd(a: pd.Series, b: pd.Series) -> pd.Series:
    """Root mean square distance of two poses (arrays of x, y, z arrays) under the best one-to-one matching of atoms; NULL if sizes differ or are 0."""

    def one(x, y):
        if x is None or y is None or len(x) != len(y) or not len(x):
            return None
        p, r = np.vstack(x).astype(float), np.vstack(y).astype(float)
        d = ((p[:, None] - r[None]) ** 2).sum(2)
        return float(np.sqrt(assign_least(d)[1] / len(p)))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
