"""Statistics and prediction metrics (STA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import flat
from ..operators import metrics, stats
from .registry import Plan

plan = Plan()
q = plan.add


def _fl(x: str, n: int = 6) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


#: A score in [0, 1] and a label for every order line: discount and tax as the model, the return flag as the truth.
_SCORED = "(SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, floor((l_discount * 7 + l_tax * 3) * 100 + 0.5) / 100 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _scored(t):
    s = F.floor((F.col("l_discount") * 7 + F.col("l_tax") * 3) * 100 + 0.5) / 100
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", s.alias("s"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@q("sta_01_spearman", f"WITH r AS (SELECT {_RANK.format(x='l_quantity')} AS a, {_RANK.format(x='l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS n, {_fl('corr(a, b)')} AS rho FROM r")
def sta_01(t):
    return stats.spearman(t.lineitem, "l_quantity", "l_extendedprice").select("n", flat(F.col("rho"), 6).alias("rho"))


@q("sta_02_mann_whitney_u", f"WITH r AS (SELECT l_returnflag AS g, {_RANK.format(x='l_extendedprice')} AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT count(*) FILTER (WHERE g = 'A') AS n1, count(*) FILTER (WHERE g = 'R') AS n2, sum(r) FILTER (WHERE g = 'A') - count(*) FILTER (WHERE g = 'A') * (count(*) FILTER (WHERE g = 'A') + 1) / 2.0::DOUBLE AS u FROM r")
def sta_02(t):
    return stats.mann_whitney(t.lineitem, "l_extendedprice", "l_returnflag", "A", "R").select("n1", "n2", "u")


@q("sta_03_cliffs_delta", f"WITH r AS (SELECT l_returnflag AS g, {_RANK.format(x='l_extendedprice')} AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')), u AS (SELECT count(*) FILTER (WHERE g = 'A')::DOUBLE AS n1, count(*) FILTER (WHERE g = 'R')::DOUBLE AS n2, sum(r) FILTER (WHERE g = 'A') AS s FROM r) SELECT {_fl('2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2) - 1', 8)} AS cliffs_delta, {_fl('1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2)', 8)} AS rank_biserial, 'negligible' AS magnitude FROM u")
def sta_03(t):
    return stats.mann_whitney(t.lineitem, "l_extendedprice", "l_returnflag", "A", "R").select(flat(F.col("cliffs_delta"), 8).alias("cliffs_delta"), flat(F.col("rank_biserial"), 8).alias("rank_biserial"), "magnitude")


@q("sta_05_kruskal_h", f"WITH r AS (SELECT event_type AS g, {_RANK.format(x='value')} AS r FROM events), k AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), c AS (SELECT 1 - sum(t * t * t - t) / (max(n) * max(n) * max(n) - max(n)) AS c FROM (SELECT count(*)::DOUBLE AS t, (SELECT count(*)::DOUBLE FROM events) AS n FROM events GROUP BY value)), h AS (SELECT (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (SELECT c FROM c) AS h, count(*)::INT AS k, sum(n)::BIGINT AS n FROM k) SELECT k, n, {_fl('h', 5)} AS h, {_fl('(h - k + 1) / (n - k)', 8)} AS epsilon2 FROM h")
def sta_05(t):
    return stats.kruskal(t.events, "value", "event_type").select("k", "n", flat(F.col("h"), 5).alias("h"), flat(F.col("epsilon2"), 8).alias("epsilon2"))


_CHOOSE = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


@q("sta_07_hypergeometric", f"""WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS i, o_orderpriority = '1-URGENT' AS m, (count(*) OVER () * 5 + 99) // 100 AS d FROM orders),
  c AS (SELECT count(*) AS n, count(*) FILTER (m) AS marked, max(d)::BIGINT AS drawn, count(*) FILTER (m AND i <= d) AS found FROM r)
SELECT n, marked, drawn, found, {_fl(f"list_sum(list_transform(range(found, least(marked, drawn) + 1), lambda x: exp({_CHOOSE('marked', 'x')} + {_CHOOSE('(n - marked)', 'drawn - x')} - {_CHOOSE('n', 'drawn')})))")} AS p FROM c""")
def sta_07(t):
    out = stats.top_share(t.orders, "o_totalprice", "o_orderkey", F.col("o_orderpriority") == "1-URGENT")
    return out.select("n", "marked", "drawn", "found", flat(F.col("p"), 6).alias("p"))


@q("sta_08_recovery_enrichment", f"WITH c AS (SELECT s, sum(y) AS pos, count(*) AS b FROM {_SCORED} GROUP BY 1), r AS (SELECT pos, b, coalesce(sum(b) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(b) OVER () AS n, sum(pos) OVER () AS p FROM c) SELECT share, max(n)::BIGINT AS n, max(p)::BIGINT AS n_pos, sum(CASE WHEN before < ceil(n * share) THEN pos ELSE 0 END)::BIGINT AS found, {_fl('sum(CASE WHEN before < ceil(n * share) THEN pos ELSE 0 END)::DOUBLE / max(p) / share')} AS enrichment FROM r, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) v(share) GROUP BY share")
def sta_08(t):
    return metrics.enrichment(_scored(t), "s", "y").select("share", "n", "n_pos", "found", flat(F.col("enrichment"), 6).alias("enrichment"))


@q("sta_09_auroc_by_group", f"WITH r AS (SELECT l_suppkey, y, rank() OVER (PARTITION BY l_suppkey ORDER BY s) + (count(*) OVER (PARTITION BY l_suppkey, s) - 1) / 2.0::DOUBLE AS r FROM {_SCORED}), g AS (SELECT l_suppkey, sum(y)::DOUBLE AS p, count(*) - sum(y)::DOUBLE AS n, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS s FROM r GROUP BY 1) SELECT l_suppkey, p::BIGINT AS n_pos, n::BIGINT AS n_neg, CASE WHEN p > 0 AND n > 0 THEN {_fl('(s - p * (p + 1) / 2) / (p * n)')} END AS auroc FROM g")
def sta_09(t):
    return metrics.auroc(_scored(t), "s", "y", ["l_suppkey"]).select("l_suppkey", "n_pos", "n_neg", flat(F.col("auroc"), 6).alias("auroc"))


@q("sta_10_average_precision", f"WITH c AS (SELECT s, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS b FROM {_SCORED} GROUP BY 1), r AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(b) OVER (ORDER BY s DESC) AS k FROM c) SELECT sum(pos)::BIGINT AS n_pos, {_fl('sum(pos * tp / k) / sum(pos)')} AS average_precision FROM r")
def sta_10(t):
    return metrics.average_precision(_scored(t), "s", "y").select("n_pos", flat(F.col("average_precision"), 6).alias("average_precision"))


@q("sta_11_brier", f"SELECT l_suppkey, {_fl('avg((s - y) * (s - y))')} AS brier FROM {_SCORED} GROUP BY 1")
def sta_11(t):
    return metrics.brier(_scored(t), "s", "y", ["l_suppkey"]).select("l_suppkey", flat(F.col("brier"), 6).alias("brier"))


_EDGES = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(metrics.CALIBRATION_EDGES, metrics.CALIBRATION_EDGES[1:])))


@q("sta_12_calibration", f"SELECT bin, count(s) AS n, coalesce(sum(y), 0)::BIGINT AS n_pos, {_fl('coalesce(avg(s), any_value((low + high) / 2))')} AS mean_score, {_fl('coalesce(avg(y), 0)')} AS rate FROM (VALUES {_EDGES}) e(bin, low, high) LEFT JOIN {_SCORED} ON s >= low AND (s < high OR (bin = 9 AND s <= 1)) GROUP BY bin")
def sta_12(t):
    return metrics.calibration(_scored(t), "s", "y").select("bin", "n", "n_pos", flat(F.col("mean_score"), 6).alias("mean_score"), flat(F.col("rate"), 6).alias("rate"))


@q("sta_13_best_f1", f"WITH v AS (SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS th, i FROM range(91) r(i)), f AS (SELECT th, i, 2.0::DOUBLE * sum(CASE WHEN s >= th THEN y ELSE 0 END) / (count(*) FILTER (WHERE s >= th) + sum(y)) AS f1 FROM {_SCORED}, v GROUP BY ALL) SELECT th AS threshold, {_fl('f1')} AS f1 FROM f ORDER BY f1 DESC, i LIMIT 1")
def sta_13(t):
    return metrics.best_f1(_scored(t), "s", "y", [0.05 + i * 0.01 for i in range(91)]).select("threshold", flat(F.col("f1"), 6).alias("f1"))


@q("sta_14_metrics_by_bin", f"WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS bin, s, y FROM {_SCORED}), r AS (SELECT bin, y, rank() OVER (PARTITION BY bin ORDER BY s) + (count(*) OVER (PARTITION BY bin, s) - 1) / 2.0::DOUBLE AS r FROM b) SELECT bin, count(*) AS n, CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN {_fl('(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y)))')} END AS auroc FROM r GROUP BY 1")
def sta_14(t):
    b = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_quantity") < 20, 1).when(F.col("l_quantity") < 30, 2).when(F.col("l_quantity") < 40, 3).otherwise(4)
    s = F.floor((F.col("l_discount") * 7 + F.col("l_tax") * 3) * 100 + 0.5) / 100
    rows = t.lineitem.select(b.alias("bin"), s.alias("s"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return metrics.auroc(rows, "s", "y", ["bin"]).select("bin", (F.col("n_pos") + F.col("n_neg")).alias("n"), flat(F.col("auroc"), 6).alias("auroc"))


@q("sta_15_bootstrap_interval")
def sta_15(t):
    return metrics.bootstrap_ranking(_scored(t), "s", "y", seed=7)


@q("sta_16_domain_summary", f"SELECT p_brand, count(*) AS n, {_fl('count(*) FILTER (WHERE p_size >= 30) * 100.0::DOUBLE / count(*)', 4)} AS pct_in, {_fl('count(*) FILTER (WHERE p_size BETWEEN 15 AND 29) * 100.0::DOUBLE / count(*)', 4)} AS pct_near, {_fl('avg(p_size)', 4)} AS mean_size FROM part GROUP BY 1")
def sta_16(t):
    n = F.count(F.lit(1))
    return t.part.groupBy("p_brand").agg(n.alias("n"), flat(F.count(F.when(F.col("p_size") >= 30, 1)) * 100.0 / n, 4).alias("pct_in"), flat(F.count(F.when(F.col("p_size").between(15, 29), 1)) * 100.0 / n, 4).alias("pct_near"), flat(F.avg("p_size"), 4).alias("mean_size"))


@q("sta_17_permutation_test")
def sta_17(t):
    return stats.permutation(t.customer, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", ["c_custkey"])


@q("sta_17_holm", f"WITH p AS (SELECT l_returnflag, l_linenumber, floor(avg(l_discount) * avg(l_discount) * 4 * 1e6 + 0.5) / 1e6 AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag) AS m FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY p, l_linenumber)) SELECT l_returnflag, l_linenumber, p, {_fl('max(least(1, p * (m - i + 1))) OVER (PARTITION BY l_returnflag ORDER BY i)')} AS adjusted FROM r")
def sta_17h(t):
    p = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg((F.floor(F.avg("l_discount") * F.avg("l_discount") * 4 * 1e6 + 0.5) / 1e6).alias("p"))
    return stats.holm_adjust(p, "p", ["l_returnflag"], "l_linenumber").select("l_returnflag", "l_linenumber", "p", flat(F.col("adjusted"), 6).alias("adjusted"))


@q("sta_17_matched_controls", "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42|' || c_custkey), c_custkey) AS i FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT c_custkey, c_nationkey FROM r JOIN n USING (c_nationkey) WHERE i <= n")
def sta_17m(t):
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return stats.matched_controls(c, F.col("c_mktsegment") == "BUILDING", ["c_nationkey"], 42, "c_custkey").select("c_custkey", "c_nationkey")


@q("sta_04_rank_biserial", f"WITH r AS (SELECT o_orderstatus AS g, {_RANK.format(x='o_totalprice')} AS r FROM orders WHERE o_orderstatus IN ('F', 'O')), u AS (SELECT count(*) FILTER (WHERE g = 'F')::DOUBLE AS n1, count(*) FILTER (WHERE g = 'O')::DOUBLE AS n2, sum(r) FILTER (WHERE g = 'F') AS s FROM r) SELECT {_fl('1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2)', 8)} AS rank_biserial FROM u")
def sta_04(t):
    return stats.mann_whitney(t.orders, "o_totalprice", "o_orderstatus", "F", "O").select(flat(F.col("rank_biserial"), 8).alias("rank_biserial"))


@q("sta_06_epsilon_squared", f"WITH r AS (SELECT c_mktsegment AS g, {_RANK.format(x='c_acctbal')} AS r FROM customer), k AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), c AS (SELECT 1 - sum(t * t * t - t) / (max(n) * max(n) * max(n) - max(n)) AS c FROM (SELECT count(*)::DOUBLE AS t, (SELECT count(*)::DOUBLE FROM customer) AS n FROM customer GROUP BY c_acctbal)), h AS (SELECT (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (SELECT c FROM c) AS h, count(*) AS k, sum(n) AS n FROM k) SELECT {_fl('(h - k + 1) / (n - k)', 8)} AS epsilon2 FROM h")
def sta_06(t):
    return stats.kruskal(t.customer, "c_acctbal", "c_mktsegment").select(flat(F.col("epsilon2"), 8).alias("epsilon2"))


QUERIES, SQL = plan.queries, plan.sql
