import datetime as dt
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import identity, joins, labels, metrics, prefix, quality, ranking, similarity, stats
from quillwork.sources import html, tables, web
from quillwork.streaming import incremental


def col(df, c):
    return [r[c] for r in df.collect()]


def test_label_edges(spark):
    rows = [("b", 5.9), ("b", 6.1), ("ab", 5.0), ("ab", 6.5), ("one", 7.0), ("six", 6.0), ("range1", 5.5), ("range1", 6.5), (None, 9.0), ("n", None)]
    out = {r.k: r for r in labels.label_table(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", (6.0,)).withColumn("any6", labels.conflict_any(6.0)).collect()}
    assert (out["b"].conflict_t6, out["b"].any6) == (False, True)
    assert out["ab"].conflict_t6 and out["ab"].label_t6 is None
    assert out["six"].label_t6 == 1.0 and not out["six"].any6
    assert not out["range1"].conflict_t6 and out["range1"].label_t6 == 1.0
    assert out["n"].n_records == 0 and out["n"].label_t6 is None and out[None].label_t6 == 1.0


def test_running_total_with_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 5).otherwise(F.col("id")).alias("v"))
    r = {x.v: (x.before, x.n, x.avg_rank) for x in prefix.value_ranks(df, "v").collect()}
    assert r[5] == (0, 400, 200.5) and r[400] == (400, 1, 401.0) and r[999] == (999, 1, 1000.0)
    assert prefix.value_ranks(df.limit(0), "v").count() == 0


def test_row_ids_and_first_seen(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (None, "c"), (2, "a")], "k int, x string")
    assert {r.x + str(r.k): r.row_id for r in identity.with_row_id(df, "k").collect()} == {"b1": 1, "a2": 2, "a3": 3, "cNone": 4}
    first = identity.first_seen(df, [F.col("x")], [F.col("k")])
    assert sorted(map(tuple, first.collect()), key=str) == sorted([(2, "a"), (1, "b"), (None, "c")], key=str)


def test_content_hash_ignores_order_not_repeats(spark):
    h = lambda v: identity.content_hash(spark.createDataFrame([(x,) for x in v], "x string"), F.col("x")).first()
    assert h(["a", "b", None]) == h([None, "b", "a"]) and h(["a", "b"]) != h(["a", "b", "b"]) and h([]).n_lines == 0


def test_islands_gaps_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9, 9, None)], "v int")
    assert sorted(col(ranking.islands(df, "v").select(ranking.compact_ranges(F.col("first"), F.col("last")).alias("s")), "s")) == ["1-3", "7", "9"]
    assert sorted(map(tuple, ranking.gaps(df, "v").collect())) == [(4, 6), (8, 8)]
    t = spark.createDataFrame([("1-3,2, 9,x,5-4,0-1",), ("",), (None,)], "t string")
    assert col(t.select(ranking.expand_ranges(F.col("t"), 8).alias("r")), "r") == [[1, 2, 3], [], None]


def test_quartile_edges(spark):
    q = ranking.quartile(spark.range(1, 11).select(F.col("id").cast("double").alias("v")), "v").groupBy("quartile").count().orderBy("quartile")
    assert col(q, "count") == [3, 2, 2, 3]


def test_lookup_keeps_rows(spark):
    left = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (None, "y", 2)], "k int, v string, i int")
    right = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (None, "null", 0)], "k int, v string, o int")
    out = joins.lookup(left, right, ["k"], [F.col("o")], {"v": F.lit("?")})
    assert {r.i: r.v for r in out.collect()} == {0: "early", 1: "early", 2: "?"}


def test_disjoint(spark):
    a, b = spark.range(3), spark.range(2, 5)
    with pytest.raises(ValueError, match="2"):
        joins.assert_disjoint(a, b, "id")
    joins.assert_disjoint(a, spark.range(5, 6), "id")


def test_radius_join_by_brute_force(spark):
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(60, 3)) * 5, rng.normal(size=(50, 3)) * 5
    mk = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)] + [(99, None, 0.0, 0.0), (98, float("nan"), 0.0, 0.0)], "i int, x double, y double, z double")
    got = {(r.l_i, r.r_i) for r in joins.radius_join(mk(p), mk(q), 2.5).collect()}
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.where(d <= 2.5))}


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1)], "s double, y int")
    assert metrics.auroc(df, "s", "y").first().auroc == pytest.approx(3.5 / 4)
    assert metrics.average_precision(df, "s", "y").first().average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.auroc(df.filter("y = 1"), "s", "y").first().auroc is None
    cal = {r.bin: r for r in metrics.calibration(spark.createDataFrame([(0.3, 1), (1.0, 1), (0.0, 0)], "s double, y int"), "s", "y").collect()}
    assert cal[2].n == 1 and cal[3].n == 0 and cal[9].n == 1 and cal[5].mean_score == pytest.approx(0.55) and cal[5].rate == 0.0
    assert metrics.best_f1(df.filter("s IS NOT NULL"), "s", "y", [0.05, 0.5, 0.85]).first().threshold == 0.5


def test_bootstrap_is_poisson(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("v"))
    r = metrics.bootstrap(df, {"m": ("v", None)}, n=100).first()
    assert 0.45 < r.m_lo < 0.5 < r.m_hi < 0.55 and r.n_draws == 100


def test_bootstrap_of_rank_metrics(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SCORE_CHUNK", 3)
    rng = np.random.default_rng(1)
    rows = [(float(s), int(rng.random() < s)) for s in rng.integers(0, 40, 400) / 40]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "s double, y int")
    r = metrics.bootstrap_ranking(df, "s", "y").first()
    assert r.n_draws == 1000

    def rank_metrics(s, y):
        pos, neg = s[y == 1], s[y == 0]
        at = [(s >= x).sum() for x in pos], [(pos >= x).sum() for x in pos]
        return np.mean((pos[:, None] > neg) + (pos[:, None] == neg) / 2), np.mean(np.array(at[1]) / at[0]), np.mean((s - y) ** 2)

    s, y = (np.array(c) for c in zip(*rows))
    assert (r.auroc, r.average_precision, r.brier) == pytest.approx(rank_metrics(s, y))
    draws = np.array([rank_metrics(s[i], y[i]) for i in (rng.integers(0, 400, 400) for _ in range(1000))])
    lo, hi = np.percentile(draws, [2.5, 97.5], axis=0)
    width = hi - lo
    assert np.all(np.abs(lo - [r.auroc_lo, r.average_precision_lo, r.brier_lo]) < 0.15 * width)
    assert np.all(np.abs(hi - [r.auroc_hi, r.average_precision_hi, r.brier_hi]) < 0.15 * width)
    few = metrics.bootstrap_ranking(spark.createDataFrame([(0.1, 0), (0.9, 1)], "s double, y int"), "s", "y").first()
    assert 300 < few.n_draws < 500 and few.auroc_lo == 1.0  # both rows drawn: (1 - 1/e)^2 of the resamples
    one = metrics.bootstrap_ranking(df.filter("y = 1"), "s", "y").first()
    assert one.n_draws == 0 and one.auroc is None and one.auroc_lo is None


def test_draws_of_the_queries(spark, sf):
    from quillwork.plans import ranking, statistics

    assert statistics.QUERIES["sta_17_permutation_test"](spark, sf).first().n_draws == 10_000
    assert statistics.QUERIES["sta_15_bootstrap_interval"](spark, sf).first().n_draws == 1_000
    assert ranking.QUERIES["smp_05_bootstrap_mean"](spark, sf).first().n_draws == 1_000


def test_share_of_the_ranking_is_drawn(spark, sf):
    from quillwork.functions.numerics import hypergeom_sf
    from quillwork.plans.statistics import QUERIES

    df = spark.createDataFrame([(i, None if i == 0 else float(min(i, 130)), i in (131, 135, 139, 5)) for i in range(140)], "id int, v double, m boolean")
    r = stats.top_share(df, "v", "id", F.col("m")).first()  # 130 to 139 share the highest value, seven of them are drawn
    assert tuple(r)[:4] == (140, 4, 7, 2) and r.p == hypergeom_sf(2, 140, 4, 7)
    assert tuple(stats.top_share(df.filter("v > 1e9"), "v", "id", F.col("m")).first())[:4] == (0, 0, 0, 0)
    o = spark.read.parquet(f"{sf}/orders.parquet").toPandas().sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True])
    top = o.head(-(-len(o) // 20))
    r = QUERIES["sta_07_hypergeometric"](spark, sf).first()
    assert (r.n, r.drawn, r.found) == (len(o), len(top), (top.o_orderpriority == "1-URGENT").sum())


def test_stats_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    m = stats.mann_whitney(df, "v", "g", "a", "b").first()
    assert m.u == 0 and m.cliffs_delta == -1 and m.rank_biserial == 1 and m.magnitude == "large"
    assert stats.kruskal(df, "v", "g").first().h == pytest.approx(2.4)
    assert stats.mann_whitney(df, "v", "g", "a", "c").first().u is None
    assert stats.kruskal(df.filter("g = 'a'"), "v", "g").first().h is None
    assert stats.permutation(df.withColumn("i", F.monotonically_increasing_id()), "v", "g", "a", "b", ["i"], n=50).first().n_draws > 0


def test_nearest_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bits = rng.random((60, 32)) < 0.4
    df = spark.createDataFrame([(i, [int(x) for x in np.flatnonzero(b)]) for i, b in enumerate(bits)] + [(99, None)], "id int, bits array<int>")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 17)
    got = {r.id: (r.nearest, r.similarity) for r in similarity.nearest(df, df, 32, exclude_self=True).collect()}
    for i in range(60):
        s = [(bits[i] & bits[j]).sum() / max(1, (bits[i] | bits[j]).sum()) if j != i else -1 for j in range(60)]
        assert got[i][0] == int(np.argmax(s)) and got[i][1] == pytest.approx(max(s))
    assert similarity.nearest(df, df.limit(0), 32).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "k int, v int")
    assert dict(map(tuple, quality.violations(df, {"positive": F.col("v") > 0}, ["k"]).collect())) == {"positive": 2, "unique k": 1}
    assert dict(map(tuple, quality.violations(df.limit(0), {"positive": F.col("v") > 0}, ["k"]).collect())) == {"positive": 0, "unique k": 0}


def test_incremental(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "k string, o int, m string")
    new = spark.createDataFrame([("a", 0, "y"), ("c", 1, "y")], "k string, o int, m string")
    out = incremental.merge_failures(old, new, spark.createDataFrame([("b",)], "k string"), "k", "o")
    assert {(r.k, r.m) for r in out.collect()} == {("a", "y"), ("c", "y")}


def test_html_edges(spark):
    page = "<table><tr><th>No<th>Family</tr><tr><td>1<td>a &amp;<br>b <a href='/x'>c</a></tr><tr><td>2</td></tr></table><table><tr><td>n</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<table><tr><td")], "i int, html string")
    got = html.records(df, "html", ["i"], {"no": "^no$", "family": "family"}).collect()
    assert sorted((r.i, r.no, r.family) for r in got) == [(1, "1", "a & b c"), (1, "2", None)] or {(r.i, r.no) for r in got} == {(1, "1"), (1, "2")}


def test_fetch_waits_and_gives_up():
    waits, calls = [], []

    def opener(req, timeout):
        calls.append(req.full_url)
        raise urllib.error.HTTPError(req.full_url, 503 if len(calls) < 5 else 404, "", {}, None)

    assert web.fetch("http://x.example/a", retries=2, opener=opener, sleep=waits.append) == (503, "")
    assert waits == [1.0, 2.0]
    rules = web.robots("User-agent: *\nDisallow: /private", "http://x.example")
    assert web.fetch("http://x.example/private/a", rules, opener=opener) == (0, "")


def test_detail_urls(spark):
    u = ["https://a.example/plants/7", "https://a.example/login/plants", "ftp://a.example/plants", "https://a.example/x?plant", None, "https://a.example/big_plant-page"]
    df = spark.createDataFrame([(x,) for x in u], "u string")
    assert col(df.select(web.detail_url(F.col("u")).alias("d")), "d") == [True, False, False, False, False, True]


def test_manifest(tmp_path):
    f = tmp_path / "a"
    f.write_text("x")
    m = str(tmp_path / "m.json")
    tables.write_manifest(m, {"n": 1}, [str(f)])
    assert tables.verify_manifest(m) == [] and json.loads(open(m).read())["n"] == 1
    f.write_text("y")
    assert tables.verify_manifest(m) == [str(f)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, v double, y int")
    assert metrics.auroc(e, "v", "y").first().auroc is None
    assert stats.spearman(e, "v", "y").first().rho is None
    assert ranking.islands(e, "y").count() == 0
    assert metrics.calibration(e, "v", "y").count() == 10
    assert labels.funnel(e, [("all", F.col("v") > 0)]).count() == 2
    assert dt.date(2025, 1, 1)


def test_dealt_groups_have_like_labels(spark):
    """100,000 groups of all sizes: whole, in the wanted shares, with like label counts."""
    from quillwork.operators import balance

    n = F.when(F.col("id") < 3, 20_000).when(F.col("id") < 300, F.col("id") % 37 + 5).otherwise(F.col("id") % 3 + 1)
    rows = spark.range(100_000).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), n)).alias("i")).select("g", F.when((F.col("g") * 7 + F.col("i")) % 10 < F.when(F.col("g") % 2 == 0, 7).otherwise(2), "x").otherwise("y").alias("label"))
    shares = [0.8, 0.1, 0.1]
    parts = balance.place(rows, "g", "label", shares)
    assert parts.count() == parts.select("g").distinct().count() == 100_000
    got = {(r.part, r.label): r["count"] for r in rows.join(parts, "g").groupBy("part", "label").count().collect()}
    for label in "xy":
        whole = sum(v for (_, name), v in got.items() if name == label)
        for p, share in enumerate(shares):
            assert abs(got[p, label] - share * whole) < 0.005 * whole
    assert {r.g: r.part for r in parts.filter("g < 500").collect()} == {r.g: r.part for r in balance.place(rows.repartition(5), "g", "label", shares).filter("g < 500").collect()}


def test_deal_edges(spark):
    import numpy as np
    import pytest

    from quillwork.operators import balance

    assert balance.deal([(24, 0, 1, np.array([8.0]))], np.array([[8.0], [0.0]])) == [(24, 0, [1, 0])]
    assert balance.deal([(0, 0, 10, np.array([10.0]))], np.array([[5.0], [5.0]])) == [(0, 0, [5, 5])]
    e = spark.createDataFrame([], "g bigint, label int")
    assert balance.place(e, "g", "label", [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        balance.place(e, "g", "label", [0.0])
    odd = spark.createDataFrame([(1, None, "a"), (None, 1, "b"), (2, 3, "c")], "g bigint, label int, n string")
    assert sorted(r.g for r in balance.place(odd, "g", "label", [1.0, 1.0]).collect()) == [1, 2]


def test_variant_groups_by_brute_force(spark, monkeypatch):
    import random
    import re
    from difflib import SequenceMatcher

    from quillwork.functions import names
    from quillwork.operators import variants

    monkeypatch.setattr(variants, "CHUNK", 3)  # several chunks a group
    rng = random.Random(4)
    words = ["quercetin", "quercetol", "rutinoside", "rutinosid", "cis", "2", "alpha", "(E)", "acid", "3'b", "L", "kaempferol"]
    rows = []
    for g in range(150):
        base = rng.sample(words, 2)
        for _ in range(rng.randint(1, 7)):
            w = [x if rng.random() < 0.85 else rng.choice(words) for x in base]
            rows.append((g, rng.choice(["-", " ", ", "]).join(w).replace("s", rng.choice("sss§"))))
    rows += [(None, "x"), (1, None), (900, "one"), (901, "?"), (901, "+")]
    stem = lambda x: re.sub("[^a-z0-9]", "", "".join(w for w in re.split(r"\W+", re.sub("[?±+]", "", x.lower())) if w not in names.STEREO_WORDS and not re.fullmatch("[0-9]+[a-z]?", w)))
    lead = lambda x: next((w for w in re.split(r"[\s()\[\]+±?,/\\0-9-]+", x.lower()) if len(w) >= 3 and w not in names.LIGHT_WORDS), "")
    groups = {}
    for g, n in rows:
        if g is not None and n is not None:
            groups.setdefault(g, set()).add(n)
    want = {}
    for g, ns in groups.items():
        if len(ns) < 2:
            continue
        stems = sorted({stem(n) for n in ns})
        alike = len(stems) == 1 or len({lead(n) for n in ns} - {""}) == 1 or all(SequenceMatcher(None, a, b).ratio() >= names.SAME_STEM for i, a in enumerate(stems) for b in stems[i + 1 :])
        want[g] = (len(ns), "one" if alike else "several")
    out = {r.g: (r.n_names, r.kind) for r in variants.variant_groups(spark.createDataFrame(rows, "g bigint, n string"), "g", "n").collect()}
    assert out == want and {k for _, k in want.values()} == {"one", "several"}


def test_query_names(spark):
    from quillwork.functions import names

    rows = [("Gunoa resiis L. subsp. vitipoa (L.) Vorth.", "subspecies", "Gunoa resiis L. subsp. vitipoa"), ("Gunoa resiis (L.) Vorth. subsp. vitipoa", "subspecies", "Gunoa resiis subsp. vitipoa"), ("Bodaia galaa L. var. vitrua (X.) Y.", "variety", "Bodaia galaa var. vitrua"), ("Rubria vadroka (L.) Br.", "parenthetical author", "Rubria vadroka"), ("Rubria vadroka L. ex Br.", "several authors", "Rubria vadroka"), ("Rubria Hook. f.", "several authors", "Rubria Hook."), ("Rubria vadroka L.", "one author", "Rubria vadroka"), (" Rubria vadroka ", "review", "Rubria vadroka"), ("Rubria subsp.", "review", "Rubria subsp."), ("", "review", "")]
    out = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, n string").select("i", names.query_name(F.col("n")).alias("q")).orderBy("i").collect()
    assert [(r.q.pattern, r.q.query) for r in out] == [r[1:] for r in rows]
    assert spark.createDataFrame([(None,)], "n string").select(names.query_name(F.col("n")).alias("q")).first().q is None
