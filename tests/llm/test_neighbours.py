import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import neighbours, q_vectors

from ..compare import check, connect


def brute(vecs, k):
    keys = sorted(vecs)
    x = np.array([vecs[a] / np.linalg.norm(vecs[a]) for a in keys])
    s = np.round(x @ x.T, 5)
    np.fill_diagonal(s, -2)
    return {a: [(keys[j], s[i, j]) for j in sorted(range(len(keys)), key=lambda j: (-s[i, j], keys[j]))[:k]] for i, a in enumerate(keys) if len(keys) > 1}


def frame(spark, vecs, extra=()):
    return spark.createDataFrame([(k, [float(x) for x in v], "clash") for k, v in vecs.items()] + [(*e, "clash") for e in extra], "key string, vec array<float>, id string")


def result(df, k, dim):
    out = {}
    for r in sorted(neighbours.neighbours(df, "key", "vec", dim, k).collect(), key=lambda r: (r.key, r["rank"])):
        out.setdefault(r.key, []).append((r.other, r.similarity))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_D", 64)
    monkeypatch.setattr(neighbours, "TILE_Q", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    vecs = {f"k{i:04d}": (centre[i % 12] + rng.normal(size=16) * 0.3) * 10.0 ** rng.integers(-3, 4) for i in range(400)}
    bad = [("n1", None), ("n2", [0.0] * 16), ("n3", [1.0] * 15), ("n4", [float("nan")] + [1.0] * 15), (None, [1.0] * 16), ("n5", [float("inf")] + [0.0] * 15)]
    got, want = result(frame(spark, vecs, bad), 5, 16), brute(vecs, 5)
    assert set(got) == set(want)
    for a in want:
        assert [s for _, s in got[a]] == pytest.approx([s for _, s in want[a]], abs=2e-5)
        least = min(s for _, s in want[a]) + 5e-5
        assert {o for o, s in want[a] if s > least} <= {o for o, _ in got[a]}


def test_copies(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=8)
    vecs = {f"c{i:03d}": same * (i + 1) for i in range(150)} | {f"o{i:03d}": rng.normal(size=8) for i in range(150)}
    got = result(frame(spark, vecs), 5, 8)
    assert [o for o, _ in got["c000"]] == ["c001", "c002", "c003", "c004", "c005"]
    assert [o for o, _ in got["c149"]] == ["c000", "c001", "c002", "c003", "c004"]
    assert all(len(v) == 5 for v in got.values()) and all(s == pytest.approx(1) for _, s in got["c020"])


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_D", 128)
    rng = np.random.default_rng(8)
    same = rng.normal(size=16)
    vecs = {f"c{i:03d}": same + rng.normal(size=16) * 0.01 for i in range(300)} | {f"o{i:03d}": rng.normal(size=16) for i in range(300)}
    got, want = result(frame(spark, vecs), 5, 16), brute(vecs, 5)
    for a in want:
        assert [s for _, s in got[a]] == pytest.approx([s for _, s in want[a]], abs=2e-5)


def test_few_and_none(spark):
    one = {"a": np.ones(4)}
    assert result(frame(spark, one), 5, 4) == {}
    two = one | {"b": np.array([1.0, 0, 0, 0])}
    assert result(frame(spark, two), 5, 4) == {"a": [("b", pytest.approx(0.5))], "b": [("a", pytest.approx(0.5))]}
    assert neighbours.neighbours(frame(spark, two).limit(0), "key", "vec", 4).count() == 0
    assert result(frame(spark, two).unionByName(frame(spark, two)), 5, 4).keys() == {"a", "b"}


def test_bound_covers_the_error():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, s, e = neighbours.quantise(x)
    approx = (c.astype(np.float32) @ c.astype(np.float32).T) * s * s[:, None]
    bound = e[:, None] + (1 + e[:, None]) * e + 6e-6
    assert (np.abs(approx - x @ x.T) <= bound).all() and c.dtype == np.int8


def test_found(spark, sf):
    check(q_vectors.p5_found(spark, sf), connect(sf), q_vectors.SQL["p5_found"])
    assert q_vectors.p5_neighbours(spark, sf).agg(F.max("rank")).first()[0] == 5


def test_query_blocks_are_dealt_once(spark):
    """Every point is a query in one group, whatever the files, and data rows meet it from all of them."""
    assert neighbours._cut([3, 1, 4], 3) == [0, 2, 5, 8]
    rng = np.random.default_rng(11)
    vecs = {f"k{i:04d}": rng.normal(size=8) for i in range(3000)}
    df = frame(spark, vecs).repartition(7)
    out = neighbours.neighbours(df, "key", "vec", 8, 3).groupBy("key").count().collect()
    assert len(out) == 3000 and all(r["count"] == 3 for r in out)
    keys = rng.choice(3000, 20, replace=False)
    x = np.array([vecs[f"k{i:04d}"] / np.linalg.norm(vecs[f"k{i:04d}"]) for i in range(3000)])
    got = result(df, 3, 8)
    for i in keys:
        s = x @ x[i]
        s[i] = -2
        assert [sim for _, sim in got[f"k{i:04d}"]] == pytest.approx(sorted(s, reverse=True)[:3], abs=2e-5)
