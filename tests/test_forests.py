import numpy as np

from quillwork.operators import learning


def test_forest_leaves_out_and_counts_invalid_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a > 0), i % 10) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    rows += [(None, 1.0, 1, 1), (float("nan"), 1.0, 0, 2), (1.0, 1.0, None, 3)]
    df = spark.createDataFrame(rows, "a double, b double, y int, g int")
    out = learning.forest_cv(df, ["a", "b"], "y", "g", [{"numTrees": 3, "maxDepth": 2}, {"numTrees": 5, "maxDepth": 3}], k=3).collect()
    assert [r.n_invalid for r in out] == [3, 3] and sum(r.chosen for r in out) == 1 and min(r.auroc for r in out) > 0.9


def test_forest_queries_are_whole(spark, sf, monkeypatch):
    from quillwork.plans import learning as plans

    seen = []
    monkeypatch.setattr(learning, "forest_cv", lambda *a, **kw: seen.append((a, kw)))
    plans.QUERIES["ml_01_forest_grouped_cv"](spark, sf)
    (_, features, _, _, grid), kw = seen[0]
    assert len(features) == 64 and kw.get("k", 5) == 5
    assert {(g["numTrees"], g["featureSubsetStrategy"]) for g in grid} == {(n, m) for n in (300, 600) for m in ("sqrt", "0.1")}
    rows = plans.QUERIES["ml_06_score_all_rows"](spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and rows.probability.between(0, 1).all()
    assert rows.similarity.between(0, 1).all() and (rows.similarity[rows.nearest == rows.vec_id] == 1).all()
