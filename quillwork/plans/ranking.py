"""Windows, sorts, top-k and samples (WIN, SRT, SMP)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import flat
from ..operators import ranking as op
from ..operators.identity import first_seen, with_row_id
from .registry import Plan

plan = Plan()
q = plan.add


def _fl(x: str, n: int = 6) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


@q("win_01_rank_three_keys", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_discount >= 0.05) DESC, l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber) AS rnk FROM lineitem")
def win_01(t):
    w = W.partitionBy("l_suppkey").orderBy((F.col("l_discount") >= 0.05).desc(), F.desc("l_extendedprice"), F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("rnk"))


@q("win_02_rank_within_flag", "SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_discount >= 0.05) DESC, l_extendedprice DESC, l_orderkey, l_linenumber) END AS rnk FROM lineitem")
def win_02(t):
    w = W.partitionBy("l_suppkey").orderBy((F.col("l_discount") >= 0.05).desc(), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.05, F.row_number().over(w)).cast("bigint").alias("rnk"))


@q("win_03_rank_min_support", "WITH g AS (SELECT s_nationkey, l_suppkey, count(DISTINCT l_partkey) AS n, max(l_quantity) AS best, avg(l_quantity) FILTER (WHERE l_discount > 0.09) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT s_nationkey, l_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(m * 1e6) DESC NULLS LAST, best DESC, n DESC, l_suppkey) AS rnk FROM g WHERE n >= 3")
def win_03(t):
    s = t.supplier.select("s_suppkey", "s_nationkey")
    g = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"), F.max("l_quantity").alias("best"), F.avg(F.when(F.col("l_discount") > 0.09, F.col("l_quantity"))).alias("m")).filter("n >= 3")
    w = W.partitionBy("s_nationkey").orderBy(F.floor(F.col("m") * 1e6).desc_nulls_last(), F.desc("best"), F.desc("n"), "l_suppkey")
    return g.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_suppkey", F.row_number().over(w).cast("bigint").alias("rnk"))


@q("win_04_global_percentile_rank", f"SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS rnk, {_fl('rank() OVER (ORDER BY o_totalprice DESC) * 100.0::DOUBLE / count(*) OVER ()')} AS pct FROM orders")
def win_04(t):
    return op.global_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.col("rank").alias("rnk"), flat(F.col("pct"), 6).alias("pct"))


@q("win_05_zscore_in_group", f"SELECT event_id, {_fl('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)')} AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def win_05(t):
    from ..functions.columns import safe_ratio as ratio

    s = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return t.events.select("event_id", "event_type", "value").join(s, "event_type").select("event_id", flat(ratio(F.col("value") - F.col("m"), F.col("s")), 6).alias("z"))


@q("win_06_pct_rank_in_group", f"SELECT o_orderkey, {_fl('(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY o_custkey)')} AS pct FROM orders")
def win_06(t):
    return t.orders.select("o_orderkey", flat(op.percent_rank_of_ties("o_totalprice", ["o_custkey"]), 6).alias("pct"))


@q("win_07_cumulative_recovery", f"WITH e AS (SELECT event_id, value * 100000000 + event_id AS k, event_type = 'purchase' AS hit FROM events) SELECT event_id, row_number() OVER (ORDER BY k DESC) AS rnk, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS found, {_fl('sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)::DOUBLE / nullif(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (), 0)')} AS share FROM e")
def win_07(t):
    e = t.events.select("event_id", (F.col("value") * 100000000 + F.col("event_id")).alias("k"), (F.col("event_type") == "purchase").alias("hit"))
    c = op.cumulative(e, "k", F.col("hit"))
    return c.select("event_id", F.col("rank").alias("rnk"), "found", flat(F.col("share"), 6).alias("share"))


@q("win_08_quartiles_by_edges", "WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 WHEN o_totalprice <= c THEN 3 ELSE 4 END AS quartile, o_orderstatus, count(*) AS n FROM orders, e GROUP BY ALL")
def win_08(t):
    return op.quartile(t.orders.select("o_orderstatus", "o_totalprice"), "o_totalprice").groupBy("quartile", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("win_09_duplicate_flags", "SELECT record_id, count(*) OVER (PARTITION BY name) > 1 AS dup_name, count(*) OVER (PARTITION BY name) > 1 AND NOT count(*) OVER (PARTITION BY name, status) > 1 AS dup_name_only FROM names WHERE name IS NOT NULL")
def win_09(t):
    n = t.names.filter("name IS NOT NULL")
    a = n.groupBy("name").agg(F.count(F.lit(1)).alias("a"))
    b = n.groupBy("name", "status").agg(F.count(F.lit(1)).alias("b")).withColumnRenamed("name", "_n").withColumnRenamed("status", "_s")
    j = n.select("record_id", "name", "status").join(a, "name").join(b, (F.col("name") == F.col("_n")) & F.col("status").eqNullSafe(F.col("_s")))
    return j.select("record_id", (F.col("a") > 1).alias("dup_name"), ((F.col("a") > 1) & ~(F.col("b") > 1)).alias("dup_name_only"))


@q("win_10_first_seen", "SELECT arg_min(event_id, event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def win_10(t):
    return first_seen(t.events.select("event_id", "user_id", "event_type"), [F.col("user_id"), F.col("event_type")], [F.col("event_id")])


@q("win_11_surrogate_ids", "SELECT 'C' || lpad(row_number() OVER (ORDER BY inchikey_connectivity)::VARCHAR, 6, '0') AS candidate_id, inchikey_connectivity FROM compounds_unique")
def win_11(t):
    n = with_row_id(t.compounds_unique.select("inchikey_connectivity"), "inchikey_connectivity")
    return n.select(F.concat(F.lit("C"), F.lpad(F.col("row_id").cast("string"), 6, "0")).alias("candidate_id"), "inchikey_connectivity")


_BAD = "CASE WHEN event_type = $$error$$ OR value < 5 THEN 1.0::DOUBLE ELSE 0 END"
_LAST = "OVER (PARTITION BY user_id ORDER BY event_id ROWS 199 PRECEDING)"


@q("win_12_rolling_error_rate", f"SELECT user_id, event_id, {_fl(f'avg({_BAD}) {_LAST}')} AS rate, count(*) {_LAST} >= 50 AND avg({_BAD}) {_LAST} > 0.05 AS pause FROM events")
def win_12(t):
    return op.error_rate(t.events.select("user_id", "event_id", F.when((F.col("event_type") == "error") | (F.col("value") < 5), 1.0).otherwise(0.0).alias("bad")), ["user_id"], "event_id", "bad").select("user_id", "event_id", flat(F.col("rate"), 6).alias("rate"), "pause")


#: Cohort groups by priority; D is the rest, of which each supplier has its first twelve.
_PRIO = "CASE WHEN l_discount >= 0.1 THEN 'A' WHEN l_tax >= 0.08 AND l_quantity >= 45 THEN 'B' WHEN l_extendedprice < 1000 THEN 'C' WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 'E' ELSE 'D' END"


@q("win_13_priority_cohort", f"""WITH p AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, {_PRIO} AS cohort FROM lineitem), o AS (SELECT *, CASE cohort WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'E' THEN 4 ELSE 5 END AS i FROM p),
  f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY i, l_orderkey, l_linenumber) AS k FROM o), u AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, cohort ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM f WHERE k = 1)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, cohort FROM u WHERE cohort <> 'D' OR r <= 12""")
def win_13(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.expr(_PRIO).alias("cohort"))
    return op.priority_cohort(rows, ["l_suppkey"], ["l_partkey"], "cohort", ["A", "B", "C", "E"], "D", 12, ["l_orderkey", "l_linenumber"])


@q("win_14_compact_ranges", "WITH i AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT molregno AS v FROM compound_structures)) SELECT CASE WHEN min(v) = max(v) THEN min(v)::VARCHAR ELSE min(v) || '-' || max(v) END AS span, count(*) AS n FROM i GROUP BY g")
def win_14(t):
    return op.islands(t.compound_structures, "molregno").select(op.compact_ranges(F.col("first"), F.col("last")).alias("span"), "n")


@q("win_15_expand_ranges", "SELECT n_nationkey, unnest(list_sort(list_distinct(list_concat(range(greatest(n_nationkey, 1), n_nationkey + 4), [n_nationkey + 10])))) AS v FROM nation")
def win_15(t):
    k = F.col("n_nationkey")
    text = F.format_string("%d-%d, %d,x", k, k + 3, k + 10)
    return t.nation.select("n_nationkey", F.explode(op.expand_ranges(text, 1000).cast("array<bigint>")).alias("v"))


@q("win_16_representative_row", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS i FROM events WHERE value > 10) WHERE i = 1")
def win_16(t):
    return first_seen(t.events.filter("value > 10").select("user_id", "event_type", "event_id", "value"), [F.col("user_id"), F.col("event_type")], [F.col("value"), F.col("event_id")])


@q("win_17_add_unseen", "SELECT molregno, 'verified' AS status FROM compound_structures UNION ALL SELECT DISTINCT molregno, 'backfilled' FROM split_draft WHERE molregno NOT IN (SELECT molregno FROM compound_structures)")
def win_17(t):
    s = t.compound_structures.select("molregno")
    new = t.split_draft.select("molregno").distinct().join(s, "molregno", "left_anti")
    return s.withColumn("status", F.lit("verified")).unionByName(new.withColumn("status", F.lit("backfilled")))


@q("srt_01_multi_key_sort", "SELECT inchikey_connectivity, n_plants, n_source_rows FROM compounds_unique ORDER BY n_plants DESC, n_source_rows DESC, inchikey_connectivity")
def srt_01(t):
    return t.compounds_unique.select("inchikey_connectivity", "n_plants", "n_source_rows").orderBy(F.desc("n_plants"), F.desc("n_source_rows"), "inchikey_connectivity")


@q("srt_02_top_n", "SELECT inchikey_connectivity, n_plants FROM compounds_unique ORDER BY n_plants DESC, inchikey_connectivity LIMIT 20")
def srt_02(t):
    return t.compounds_unique.select("inchikey_connectivity", "n_plants").orderBy(F.desc("n_plants"), "inchikey_connectivity").limit(20)


@q("srt_03_shortlist_by_status", "WITH d AS (SELECT o_orderstatus, o_custkey, max(o_totalprice) AS best FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY best DESC, o_custkey) AS i FROM d) SELECT o_orderstatus, o_custkey, best, i AS rank FROM r WHERE i <= 10")
def srt_03(t):
    d = t.orders.groupBy("o_orderstatus", "o_custkey").agg(F.max("o_totalprice").alias("best"))
    return op.top_n(d, ["o_orderstatus"], [F.desc("best"), F.col("o_custkey")], 10)


@q("srt_04_top_n_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) WHERE i <= 3")
def srt_04(t):
    return op.top_n(t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3)


@q("srt_05_best_record", "SELECT molregno, max(struct_pack(p := pchembl_value, a := activity_id)).a AS activity_id FROM activities WHERE pchembl_value IS NOT NULL AND NOT isnan(pchembl_value) GROUP BY 1")
def srt_05(t):
    a = t.activities.filter("pchembl_value IS NOT NULL AND NOT isnan(pchembl_value)")
    return a.groupBy("molregno").agg(F.max(F.struct("pchembl_value", "activity_id")).alias("m")).select("molregno", F.col("m.activity_id").alias("activity_id"))


@q("srt_06_flag_first_order", "SELECT p_partkey, p_size >= 40 AS large, p_retailprice FROM part ORDER BY large DESC, p_retailprice DESC, p_partkey")
def srt_06(t):
    return t.part.select("p_partkey", (F.col("p_size") >= 40).alias("large"), "p_retailprice").orderBy(F.desc("large"), F.desc("p_retailprice"), "p_partkey")


_HASH = "sha256('42|' || {id})"


@q("smp_01_two_strata", f"WITH s AS (SELECT record_id, status = 200 AS hit, row_number() OVER (PARTITION BY status = 200 ORDER BY {_HASH.format(id='record_id')}, record_id) AS i FROM names WHERE status IS NOT NULL) SELECT record_id, hit FROM s WHERE i <= CASE WHEN hit THEN 60 ELSE 40 END")
def smp_01(t):
    s = t.names.filter("status IS NOT NULL").select("record_id", (F.col("status") == 200).alias("hit"))
    return op.sample_n(s, ["hit"], F.when(F.col("hit"), 60).otherwise(40), 42, "record_id")


@q("smp_02_half_and_half", f"WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY {_HASH.format(id='o_orderkey')}, o_orderkey) AS i FROM orders) SELECT o_orderkey, done FROM s WHERE i <= 50")
def smp_02(t):
    return op.sample_n(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done")), ["done"], 50, 42, "o_orderkey")


@q("smp_03_first_n_by_stratum", "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i <= 4")
def smp_03(t):
    return op.top_n(t.events.select("event_id", "event_type"), ["event_type"], [F.col("event_id")], 4).drop("rank")


@q("smp_04_seeded_sample", f"SELECT molregno FROM compound_structures ORDER BY {_HASH.format(id='molregno')}, molregno LIMIT 100")
def smp_04(t):
    return t.compound_structures.select("molregno").orderBy(op.hash_order(42, "molregno"), "molregno").limit(100)


@q("smp_05_bootstrap_mean")
def smp_05(t):
    from ..operators.metrics import bootstrap

    return bootstrap(t.events, {"mean_value": ("value", None)}, seed=42)


QUERIES, SQL = plan.queries, plan.sql
