"""The k most similar vectors of every vector, exactly, by a block matrix join.

Vectors are scaled to length one and packed into blocks, which are written once to the shared
folder. A task holds a group of query blocks and reads every block from there, so vectors are
shuffled at most once and never multiplied. A tile of int8 products gives all similarities of
a query slab with a data slab, each within a bound known from the rows' quantisation errors. A
pair survives if its product plus that bound reaches the query's k-th best so far; survivors
are recomputed in float and pushed into the queries' heaps. So nothing is lost to
quantisation, and tiles are one matrix product and one comparison.

Products of int8 codes over a few hundred dimensions are exact in float32, which lets the
tile run on the BLAS kernel.

Vectors of one direction (to six decimals) are one point of the join with their K smallest
keys, so a third of all rows being copies of one vector neither fills a heap nor emits pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget, materialize, read_parquet

#: Rows of a packed block, and blocks of a file: with 64 dimensions a block takes 264 KB and a file 17 MB.
BLOCK = 1_024
FILE_BLOCKS = 64
#: Query rows that one task holds, at most (34 MB of floats); a larger table gets more tasks.
GROUP_ROWS = 131_072
#: Tile sizes: query rows by data rows.
TILE_Q, TILE_D = 1_024, 4_096
#: Share of a tile from which its survivors are recomputed as one float product.
DENSE = 0.02


def usable(vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """``key``, ``unit`` (length one, rounded to six decimals), ``h``, a hash of the direction, and ``rid``, a row number, for each usable vector.

    Not usable are vectors that are NULL, of another length, all zero, or with NULL, NaN or
    infinite members. Lines with a NULL key are left out.
    """
    rows = vectors.filter(F.col(key).isNotNull() & (F.size(vec) == dim)).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("unit"))
    schema = T.StructType([rows.schema["key"], T.StructField("unit", T.BinaryType()), T.StructField("h", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.vstack(pdf["unit"].to_list()).astype(float) if len(pdf) else np.zeros((0, dim))
            top = np.abs(x).max(1, initial=0.0)
            fine = np.isfinite(x).all(1) & (top > 0)
            x = x[fine] / top[fine, None]
            x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 6).astype("<f4") + np.float32(0)
            raw = [r.tobytes() for r in x]
            yield pd.DataFrame({"key": pdf["key"][fine].to_list(), "unit": raw, "h": [hashlib.sha256(r).hexdigest()[:32] for r in raw]})

    return rows.mapInPandas(run, schema).withColumn("rid", F.monotonically_increasing_id())


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, vecs = [], []
    for pdf in batches:
        ids.extend(pdf["rid"])
        vecs.extend(pdf["unit"])
        while len(ids) >= BLOCK:
            yield _block(ids[:BLOCK], vecs[:BLOCK])
            del ids[:BLOCK], vecs[:BLOCK]
    if ids:
        yield _block(ids, vecs)


def _block(ids: list[int], vecs: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(ids)], "ids": [np.array(ids, "<i8").tobytes()], "unit": [b"".join(vecs)]})


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the length of what rounding leaves out of each row."""
    scale = np.maximum(np.abs(x).max(1), 1e-12) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale.astype(np.float32), np.linalg.norm(x - codes * scale[:, None], axis=1).astype(np.float32)


class Heaps:
    """The k best (similarity, id) of each query row; rows of arrays, sorted with the best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.sim = np.full((n, k), -2.0, np.float32)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def push(self, q: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates into the heaps of rows ``q``; on equal similarity the smaller id is better."""
        rows = np.unique(q)
        allq = np.r_[q, np.repeat(rows, self.k)]
        alls = np.r_[sim, self.sim[rows].ravel()]
        alli = np.r_[ids, self.id[rows].ravel()]
        order = np.lexsort((alli, -alls, allq))
        allq, alls, alli = allq[order], alls[order], alli[order]
        start = np.flatnonzero(np.r_[True, allq[1:] != allq[:-1]])
        take = start[:, None] + np.arange(self.k)
        self.sim[rows], self.id[rows] = alls[take], alli[take]

    @property
    def floor(self) -> np.ndarray:
        return self.sim[:, -1]


class Search:
    """Query rows with their heaps, which data rows meet tile by tile."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.codes, self.scale, self.err = quantise(rows) if len(rows) else (rows.astype(np.int8), *np.zeros((2, 0), np.float32))
        self.heaps = Heaps(len(ids), k)
        dim = rows.shape[1]
        self.slack = 4e-6 * dim / 64 + 2e-6  # float32 rounding of the products

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(ids), TILE_D):
            self._slab(ids[a : a + TILE_D], rows[a : a + TILE_D])

    def _slab(self, ids: np.ndarray, real: np.ndarray) -> None:
        k, heaps = self.k, self.heaps
        dc, ds, de = quantise(real)
        right = dc.astype(np.float32).T  # whole numbers
        worst = float(de.max(initial=0.0))
        for b in range(0, len(self.ids), TILE_Q):
            rows = slice(b, b + TILE_Q)
            tile = self.codes[rows].astype(np.float32) @ right
            tile *= ds
            scale = self.scale[rows]
            # |x.y - sx sy cx.cy| <= ex |y| + |sx cx| ey, with |y| = 1 and |sx cx| <= 1 + ex
            bound = self.err[rows] + (1.0 + self.err[rows]) * worst + self.slack
            least = (heaps.floor[rows] - bound) / scale
            fresh = heaps.floor[rows].min(initial=0.0) < -1.5 and tile.shape[1] > 4 * k
            if fresh:
                # No heap yet: the k + 1 best products of this tile give a floor to start from.
                cut = np.partition(tile, tile.shape[1] - k - 1, axis=1)[:, tile.shape[1] - k - 1]
                least = np.maximum(least, cut - 2 * bound / scale)
            hit = np.flatnonzero(tile >= least[:, None])
            exact = None
            if len(hit) > DENSE * tile.size:
                # A crowd within the bound: one float product is cheaper than its pairs one by one.
                exact = self.rows[rows] @ real.T
                least = heaps.floor[rows]
                if fresh:
                    least = np.maximum(least, np.partition(exact, tile.shape[1] - k - 1, axis=1)[:, tile.shape[1] - k - 1])
                hit = np.flatnonzero(exact >= least[:, None])
            i, j = np.divmod(hit, tile.shape[1])
            other = ids[j] != self.ids[i + b]
            i, j = i[other], j[other]
            for s in range(0, len(i), 200_000):
                ii, jj = i[s : s + 200_000], j[s : s + 200_000]
                sim = np.einsum("ij,ij->i", self.rows[ii + b], real[jj]) if exact is None else exact[ii, jj]
                good = sim >= heaps.floor[ii + b]
                if good.any():
                    heaps.push(ii[good] + b, sim[good], ids[jj[good]])

    def found(self) -> pd.DataFrame:
        n, k = self.heaps.sim.shape
        ok = self.heaps.sim.ravel() > -1.5
        return pd.DataFrame({"q": np.repeat(self.ids, k)[ok], "d": self.heaps.id.ravel()[ok], "sim": self.heaps.sim.ravel()[ok].astype(float)})


def _unpack(table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
    return ids, np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f4").reshape(len(ids), dim)


def _searcher(files: list[tuple[str, int]], edges: list[int], dim: int, k: int):
    """Searches the query blocks ``edges[g]`` to ``edges[g + 1]`` of a group against all files (path, blocks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"].tolist():
                lo, hi = edges[g], edges[g + 1]
                own, first = [], 0
                for path, n in files:
                    a, b = max(lo, first), min(hi, first + n)
                    if a < b:
                        own.append(read_parquet(path, ["ids", "unit"]).slice(a - first, b - a))
                    first += n
                if not own:
                    continue
                ids, rows = zip(*(_unpack(t, dim) for t in own))
                search = Search(np.concatenate(ids), np.concatenate(rows), k)
                del own, rows
                start = g * len(files) // (len(edges) - 1)  # tasks start at different files
                for path, _ in files[start:] + files[:start]:
                    search.meet(*_unpack(read_parquet(path, ["ids", "unit"]), dim))
                yield search.found()

    return run


def _cut(counts: list[int], groups: int) -> list[int]:
    """Edges of ``groups`` runs of blocks of like size."""
    total = sum(counts)
    return [total * g // groups for g in range(groups + 1)]


def neighbours(vectors: DataFrame, key: str, vec: str, dim: int, k: int = 5) -> DataFrame:
    """``key``, ``other``, ``similarity`` (cosine), ``rank``: the k most similar other keys of each usable vector.

    On equal similarity (to six decimals) the smaller key ranks first. Vectors that are NULL,
    zero, of another length or with NaN take no part; a lone vector has no neighbours; an
    empty table gives no lines. Two vectors of the same direction are each other's
    neighbours at similarity 1. Of repeated keys one line is kept, that of the greatest hash
    of the direction.
    """
    spark = vectors.sparkSession
    unit = materialize(usable(vectors, key, vec, dim), "unit")
    one = materialize(unit.groupBy("key").agg(F.max(F.struct("h", "rid")).alias("m")).select("key", "m.h", "m.rid"), "keys")
    # Of a direction the k + 1 smallest keys are kept; the smallest stands for it. Groups are cut before they are shuffled.
    order = W.partitionBy("h").orderBy("key")
    kept = one.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k + 1).withColumn("id", F.first("rid").over(order))
    kept = materialize(kept.select("h", "key", "pos", "id"), "members")
    n_points = kept.filter("pos = 1").count()
    heads = kept.filter("pos = 1").select("h", "id")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("unit", T.BinaryType())])
    packed = unit.select("rid", "unit").join(heads.select(F.col("id").alias("rid")), "rid", "left_semi").mapInPandas(_pack, schema)
    blocks = materialize(packed, "blocks", maxRecordsPerFile=FILE_BLOCKS)
    forget(unit)
    files = [(r["path"], r["n"]) for r in blocks.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect()]  # one line a file of FILE_BLOCKS blocks
    n_blocks = sum(n for _, n in files)
    groups = max(1, min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, -(-n_points // GROUP_ROWS))))
    found = T.StructType([T.StructField("q", T.LongType()), T.StructField("d", T.LongType()), T.StructField("sim", T.DoubleType())])
    near = spark.range(0, groups, 1, groups).mapInPandas(_searcher(files, _cut([n for _, n in files], groups), dim, k), found)
    near = materialize(near, "near")
    forget(blocks)

    of = F.round(F.greatest(F.least(F.col("sim"), F.lit(1.0)), F.lit(-1.0)), 6)
    # Neighbours of a point: the members of near points, and its own other members.
    reach = near.join(kept.select(F.col("id").alias("d"), F.col("key").alias("other")), "d").select(F.col("q").alias("id"), "other", of.alias("similarity"))
    reach = reach.unionByName(kept.select("id", F.col("key").alias("other"), F.lit(1.0).alias("similarity")))
    # A key needs the k best others, so a point needs its k + 1 best; it has at most (k + 1) squared candidates.
    best = reach.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("other")))), 1, k + 1).alias("best"))
    mine = one.select("key", "h").join(heads, "h").select("key", "id")
    others = F.slice(F.filter("best", lambda b: b["other"] != F.col("key")), 1, k)
    ranked = mine.join(best, "id").select("key", F.posexplode(others).alias("pos", "b"))
    return ranked.select("key", F.col("b.other").alias("other"), (-F.col("b.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))
