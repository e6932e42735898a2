import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import q_activities, quantiles

from ..compare import check, connect


def rank_error(values, p, got):
    v = np.sort(values)
    lo, hi = np.searchsorted(v, got, "left") / len(v), np.searchsorted(v, got, "right") / len(v)
    return max(0.0, lo - p, p - hi)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=400), st.integers(3, 50))
def test_collapse_keeps_weight_and_order(rows, k):
    g, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    og, ov, ow, oe = quantiles.collapse(g, v, np.ones(len(g)), np.zeros(len(g)), k)
    for x in np.unique(g):
        n = (g == x).sum()
        assert ow[og == x].sum() == pytest.approx(n)
        assert (og == x).sum() == min(n, k)
        assert set(ov[og == x]) <= set(v[g == x])
        assert oe[og == x].sum() == pytest.approx(n / (2 * k) if n > k else 0)
        for p in (0.1, 0.5, 0.9):
            s = np.sort(ov[og == x])
            got = s[min(len(s) - 1, np.searchsorted(np.cumsum(ow[og == x][np.argsort(ov[og == x])]), p * n - 1e-9))]
            assert rank_error(v[g == x], p, got) <= 0.5 / k + 1.0 / n + 1e-9


def test_hot_key_and_days(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK", 5_000)
    monkeypatch.setattr(quantiles, "FAN_IN", 3)  # several levels
    df = spark.range(60_000).repartition(8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("k%d", F.col("id") % 997)).alias("k"), (F.col("id") % 4).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0).alias("value"))
    by_day = quantiles.summarise(df, ["k", "day"], 200)
    assert by_day.groupBy("k", "day").count().agg(F.max("count")).first()[0] <= 200
    out = {r.k: r for r in quantiles.percentiles(quantiles.merge(by_day, ["k"], 200), ["k"], [0.1, 0.5, 0.9]).collect()}
    exact = df.toPandas().groupby("k")["value"].apply(np.array)
    assert set(out) == set(exact.index)
    for k, v in exact.items():
        assert out[k].n == len(v)
        for p, got in ((0.1, out[k].p10), (0.5, out[k].p50), (0.9, out[k].p90)):
            assert rank_error(v, p, got) <= out[k].rank_error + 1e-9
        assert out[k].rank_error < 0.02 and (len(v) > 200 or out[k].rank_error == 0)


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled", "ends"])
def test_bound_holds_over_many_chunks(order):
    """100 chunks of one key: the counted bound holds in any order and grows with the levels, not with the chunks."""
    import pandas as pd

    k, n = 64, 100 * 1000
    v = np.arange(n, dtype=float)
    if order == "reversed":
        v = v[::-1]
    elif order == "shuffled":
        v = np.random.default_rng(0).permutation(v)
    elif order == "ends":
        v = np.ravel(np.column_stack([v[: n // 2], v[::-1][: n // 2]]))
    tower = quantiles.Tower(lambda pdf: quantiles._reduce(pdf, ["key"], k))
    for a in range(0, n, 1000):
        chunk = pd.DataFrame({"key": "x", "value": v[a : a + 1000], "weight": 1.0, "err": 0.0})
        assert tower.add(tower.reduce(chunk)) is None
    out = tower.close()
    bound = out["err"].sum() / n
    levels = 1 + int(np.ceil(np.log(100) / np.log(quantiles.FAN))) + 1
    assert bound <= levels / (2 * k) + 1e-9 and len(out) == k
    run = np.cumsum(out["weight"])
    for p in np.linspace(0.01, 0.99, 99):
        got = out["value"].to_numpy()[np.searchsorted(run, p * n - 1e-6)]
        assert rank_error(v, p, got) <= bound + 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_bound_holds_in_sorted_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "CHUNK", 2_000)
    monkeypatch.setattr(quantiles, "FAN_IN", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.range(0, 120_000, 1, parts).select(F.lit("one").alias("k"), F.col("id").cast("double").alias("value"))
        out = quantiles.percentiles(quantiles.summarise(df, ["k"], 100), ["k"], [0.1, 0.5, 0.99]).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.n == 120_000 and 0 < out.rank_error < 0.06
    for p, got in ((0.1, out.p10), (0.5, out.p50), (0.99, out.p99)):
        assert abs(got / 120_000 - p) <= out.rank_error + 1e-5


def test_one_key_in_many_lines(spark, monkeypatch):
    """Keys before, with and after one whose summaries do not fit at once."""
    monkeypatch.setattr(quantiles, "FAN_IN", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        df = spark.range(30_000).select(F.when(F.col("id") < 20_000, "m").when(F.col("id") % 2 == 0, "a").otherwise("z").alias("k"), F.col("id").cast("double").alias("value"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("err"))
        out = {r.k: r for r in quantiles.percentiles(quantiles.merge(df, ["k"], 50), ["k"], [0.5]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: r.n for k, r in out.items()} == {"m": 20_000, "a": 5_000, "z": 5_000}
    assert abs(out["m"].p50 - 10_000) <= out["m"].rank_error * 20_000 + 1 and out["m"].rank_error < 0.1


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("a", 2.0)], "k string, value double")
    out = {r.k: (r.n, r.p50) for r in quantiles.percentiles(quantiles.summarise(df, ["k"]), ["k"], [0.5]).collect()}
    assert out == {None: (2, 1.0), "a": (1, 2.0)}
    assert quantiles.percentiles(quantiles.summarise(df.limit(0), ["k"]), ["k"], [0.5]).count() == 0


def test_valid_values(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    rows = [(1, 7, t[0], 5.0, "d"), (1, 7, t[1], 6.0, "d"), (1, 7, t[1], 6.0, "d"), (2, 7, t[0], 5.0, "d"), (2, 7, t[1], float("nan"), "d"), (3, None, t[0], 5.0, "d"), (4, 7, t[0], 15.0, "d"), (5, 7, None, 1.0, None), (None, 7, t[0], 3.0, "d"), (6, 7, t[0], None, "d")]
    df = spark.createDataFrame(rows, "activity_id bigint, molregno bigint, loaded_at timestamp_ntz, pchembl_value double, batch_day string")
    assert sorted(r.value for r in q_activities.valid_values(df).collect()) == [1.0, 6.0]


def test_found(spark, sf):
    check(q_activities.p4_found(spark, sf), connect(sf), q_activities.SQL["p4_found"])
