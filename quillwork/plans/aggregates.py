"""Aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import flat, n_if, safe_ratio, sorted_set
from ..functions.smiles import scaffold
from ..functions.text import filled
from ..operators import labels
from ..operators.identity import content_hash
from ..operators.prefix import quantiles
from ..operators.structures import by_text
from .filters import LABELS, POOL, STRICT, USABLE
from .registry import Plan, hash_sql

plan = Plan()
q = plan.add


def _fl(x: str, n: int = 6) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


@q("agg_01_stats_per_key", f"SELECT molregno, count(pchembl_value) AS n_records, quantile_cont(pchembl_value, 0.5) AS median_value, min(pchembl_value) AS min_value, max(pchembl_value) AS max_value FROM activities WHERE {POOL} GROUP BY 1")
def agg_01(t):
    return labels.per_key(t.activities.filter(labels.pool()), ["molregno"], "pchembl_value")


@q("agg_02_conditional_counts", f"SELECT molregno, count(*) AS n_all, count(*) FILTER (WHERE {USABLE}) AS n_usable, count(*) FILTER (WHERE {STRICT}) AS n_strict FROM activities GROUP BY 1")
def agg_02(t):
    return t.activities.groupBy("molregno").agg(F.count(F.lit(1)).alias("n_all"), n_if(labels.usable()).alias("n_usable"), n_if(labels.strict()).alias("n_strict"))


@q("agg_03_distinct_by_group_top", "SELECT target_chembl_id, target_pref_name, target_type, organism, count(DISTINCT molregno) AS n_molecules FROM activities WHERE target_chembl_id IS NOT NULL GROUP BY ALL ORDER BY n_molecules DESC, target_chembl_id, target_pref_name, target_type, organism LIMIT 30")
def agg_03(t):
    k = ["target_chembl_id", "target_pref_name", "target_type", "organism"]
    return t.activities.filter("target_chembl_id IS NOT NULL").groupBy(*k).agg(F.countDistinct("molregno").alias("n_molecules")).orderBy(F.desc("n_molecules"), *k).limit(30)


@q("agg_04_distinct_counts", "SELECT count(DISTINCT molregno) AS n_molecules, count(DISTINCT assay_id) AS n_assays, count(DISTINCT tid) AS n_targets, count(*) AS n FROM activities")
def agg_04(t):
    return t.activities.agg(F.countDistinct("molregno").alias("n_molecules"), F.countDistinct("assay_id").alias("n_assays"), F.countDistinct("tid").alias("n_targets"), F.count(F.lit(1)).alias("n"))


@q("agg_05_value_counts_with_null", "SELECT standard_relation, standard_units, count(*) AS n FROM activities GROUP BY ALL")
def agg_05(t):
    return t.activities.groupBy("standard_relation", "standard_units").agg(F.count(F.lit(1)).alias("n"))


@q("agg_06_median_of_medians", f"SELECT tid, quantile_cont(m, 0.5) AS median_of_medians, count(*) AS n_molecules FROM (SELECT tid, molregno, quantile_cont(pchembl_value, 0.5) AS m FROM activities WHERE {POOL} GROUP BY ALL) GROUP BY 1")
def agg_06(t):
    m = labels.per_key(t.activities.filter(labels.pool()), ["tid", "molregno"], "pchembl_value")
    return m.groupBy("tid").agg(F.percentile("median_value", F.lit(0.5)).alias("median_of_medians"), F.count(F.lit(1)).alias("n_molecules"))


@q("agg_07_conflict_any", f"SELECT molregno, target_chembl_id, n_records > 1 AND min_value < 6 AND max_value >= 6 AS conflict FROM ({LABELS})")
def agg_07(t):
    rows = t.activities.filter(labels.pool() & F.col("molregno").isNotNull() & F.col("target_chembl_id").isNotNull())
    return labels.per_key(rows, ["molregno", "target_chembl_id"], "pchembl_value").select("molregno", "target_chembl_id", labels.conflict_any(6.0).alias("conflict"))


@q("agg_08_conflict_wide", f"SELECT molregno, target_chembl_id, min_value < 6 AND max_value >= 6 AND max_value - min_value > 1.0 AS conflict FROM ({LABELS})")
def agg_08(t):
    rows = t.activities.filter(labels.pool() & F.col("molregno").isNotNull() & F.col("target_chembl_id").isNotNull())
    return labels.per_key(rows, ["molregno", "target_chembl_id"], "pchembl_value").select("molregno", "target_chembl_id", labels.conflict_wide(6.0).alias("conflict"))


@q("agg_09_label_counts", f"WITH l AS (SELECT target_chembl_id, CASE WHEN NOT (min_value < 6 AND max_value >= 6 AND max_value - min_value > 1.0) THEN CASE WHEN median_value >= 6 THEN 1 ELSE 0 END END AS y FROM ({LABELS})) SELECT target_chembl_id, count(*) FILTER (WHERE y = 1) AS n_active, count(*) FILTER (WHERE y = 0) AS n_inactive, count(*) FILTER (WHERE y IS NULL) AS n_conflict FROM l GROUP BY 1")
def agg_09(t):
    rows = t.activities.filter(labels.pool() & F.col("molregno").isNotNull() & F.col("target_chembl_id").isNotNull())
    y = labels.label_table(rows, ["molregno", "target_chembl_id"], "pchembl_value", (6.0,))
    return y.groupBy("target_chembl_id").agg(F.count(F.when(F.col("label_t6") == 1, 1)).alias("n_active"), F.count(F.when(F.col("label_t6") == 0, 1)).alias("n_inactive"), F.count(F.when(F.col("label_t6").isNull(), 1)).alias("n_conflict"))


@q("agg_10_impute_measure", f"SELECT activity_id, loaded_at, {_fl('coalesce(CASE WHEN NOT isnan(pchembl_value) THEN pchembl_value END, CASE WHEN standard_value > 0 THEN 9 - log10(standard_value) END)')} AS measure FROM activities WHERE {USABLE}")
def agg_10(t):
    return t.activities.filter(labels.usable()).select("activity_id", "loaded_at", flat(labels.imputed(F.col("pchembl_value"), F.col("standard_value")), 6).alias("measure"))


@q("agg_11_active_any_never", f"WITH m AS (SELECT molregno, bool_or(pchembl_value >= 6) AS a FROM activities WHERE {POOL} GROUP BY 1) SELECT count(*) FILTER (WHERE a) AS n_any, count(*) FILTER (WHERE NOT a) AS n_never FROM m")
def agg_11(t):
    m = t.activities.filter(labels.pool()).groupBy("molregno").agg(F.bool_or(F.col("pchembl_value") >= 6).alias("a"))
    return m.agg(F.count(F.when(F.col("a"), 1)).alias("n_any"), F.count(F.when(~F.col("a"), 1)).alias("n_never"))


_L = r"CASE WHEN regexp_matches(coalesce(standard_inchi_key,''), '[\p{L}\p{N}]') THEN substring(regexp_replace(upper(regexp_replace(standard_inchi_key, '^\s+|\s+$', '', 'g')), '^INCHIKEY=', ''), 1, 14) END"


@q("agg_12_dedupe_representative", f"WITH s AS (SELECT *, {_L} AS layer FROM compound_structures) SELECT layer, count(*) AS n_source_rows, count(DISTINCT nullif(trim(molecular_formula), '')) AS n_forms, arg_min(chembl_id, molregno) AS representative, bool_or(natural_product = 1) AS any_natural, count(DISTINCT nullif(trim(molecular_formula), '')) = 1 AND bool_and(molecular_weight IS NOT NULL AND NOT isnan(molecular_weight)) AS resolved FROM s WHERE layer IS NOT NULL GROUP BY 1")
def agg_12(t):
    from ..functions.text import connectivity

    s = t.compound_structures.withColumn("layer", connectivity(F.col("standard_inchi_key"))).filter("layer IS NOT NULL")
    form = F.countDistinct(F.nullif(F.trim("molecular_formula"), F.lit("")))
    known = F.col("molecular_weight").isNotNull() & ~F.isnan("molecular_weight")
    return s.groupBy("layer").agg(F.count(F.lit(1)).alias("n_source_rows"), form.alias("n_forms"), F.min_by("chembl_id", "molregno").alias("representative"), F.bool_or(F.col("natural_product") == 1).alias("any_natural"), ((form == 1) & F.bool_and(known)).alias("resolved"))


@q("agg_13_any_flags", "SELECT n_plants, bool_or(is_inorganic) AS inorganic, bool_or(has_metal) AS metal, bool_or(is_mixture) AS mixture, bool_or(tautomer_failed) AS failed, bool_or(charge_remaining) AS charged FROM compounds_unique GROUP BY 1")
def agg_13(t):
    return t.compounds_unique.groupBy("n_plants").agg(*(F.bool_or(c).alias(a) for c, a in (("is_inorganic", "inorganic"), ("has_metal", "metal"), ("is_mixture", "mixture"), ("tautomer_failed", "failed"), ("charge_remaining", "charged"))))


@q("agg_14_sorted_distinct_concat", "SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_partkey))), '|') AS parts, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS flags FROM lineitem GROUP BY 1")
def agg_14(t):
    parts = F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), "|")
    return t.lineitem.groupBy("l_suppkey").agg(parts.alias("parts"), sorted_set(F.col("l_returnflag")).alias("flags"))


@q("agg_15_max_flag_null_zero", "SELECT molregno, coalesce(max(CASE WHEN potential_duplicate = 1 THEN 1 ELSE 0 END), 0) AS any_duplicate, coalesce(max(confidence_score), 0) AS confidence FROM compound_structures LEFT JOIN activities USING (molregno) GROUP BY 1")
def agg_15(t):
    a = t.activities.groupBy("molregno").agg(F.max(F.when(F.col("potential_duplicate") == 1, 1).otherwise(0)).alias("d"), F.max("confidence_score").alias("c"))
    return t.compound_structures.select("molregno").join(a, "molregno", "left").select("molregno", F.coalesce("d", F.lit(0)).alias("any_duplicate"), F.coalesce("c", F.lit(0)).alias("confidence"))


@q("agg_16_representative_max_count", "SELECT user_id, arg_max(event_type, n * 1000 - ascii(event_type)) AS top_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def agg_16(t):
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("top_type"), F.max("n").alias("n"))


@q("agg_17_first_in_order", "SELECT p_brand, arg_min(p_name, struct_pack(a := CASE WHEN p_size >= 30 THEN 0 ELSE 1 END, b := p_partkey)) AS first_name FROM part GROUP BY 1")
def agg_17(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.when(F.col("p_size") >= 30, 0).otherwise(1).alias("a"), F.col("p_partkey").alias("b"))).alias("first_name"))


_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END"


@q("agg_18_priority_max", f"SELECT o_custkey, arg_max(o_orderpriority, {_PRIORITY}) AS top_priority FROM orders GROUP BY 1")
def agg_18(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.expr(_PRIORITY)).alias("top_priority"))


@q("agg_19_mixed_flag", "SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS mixed FROM lineitem GROUP BY 1")
def agg_19(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.min("l_returnflag") < F.max("l_returnflag")).alias("mixed"))


@q("agg_20_concentration_top5", f"WITH d AS (SELECT target_chembl_id, doc_id, count(*) AS n FROM activities WHERE {POOL} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id ORDER BY n DESC, doc_id) AS i FROM d) SELECT target_chembl_id, sum(n)::BIGINT AS n_rows, sum(CASE WHEN i <= 5 THEN n ELSE 0 END)::BIGINT AS n_top5, {_fl('sum(CASE WHEN i <= 5 THEN n ELSE 0 END)::DOUBLE / sum(n)')} AS share FROM r GROUP BY 1")
def agg_20(t):
    d = t.activities.filter(labels.pool()).groupBy("target_chembl_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    r = d.withColumn("i", F.row_number().over(W.partitionBy("target_chembl_id").orderBy(F.desc("n"), "doc_id")))
    top = F.sum(F.when(F.col("i") <= 5, F.col("n")).otherwise(0))
    return r.groupBy("target_chembl_id").agg(F.sum("n").alias("n_rows"), top.alias("n_top5"), flat(top / F.sum("n"), 6).alias("share"))


@q("agg_21_scaffold_diversity")
def agg_21(t):
    s = by_text(t.compound_structures.filter(filled(F.col("canonical_smiles"))).select("canonical_smiles"), "canonical_smiles", scaffold, "scaffold").groupBy("scaffold").agg(F.count(F.lit(1)).alias("n"))
    top = s.filter("scaffold <> 'acyclic'").orderBy(F.desc("n"), "scaffold").limit(10).agg(F.sum("n").alias("top10"))
    whole = s.agg(F.sum("n").alias("n_molecules"), F.count(F.when(F.col("scaffold") != "acyclic", 1)).alias("n_scaffolds"), F.sum(F.when(F.col("scaffold") == "acyclic", F.col("n")).otherwise(0)).alias("n_acyclic"))
    return whole.crossJoin(top).select("n_molecules", "n_scaffolds", "n_acyclic", safe_ratio(F.col("top10"), F.col("n_molecules")).alias("top10_share"), safe_ratio(F.col("n_acyclic"), F.col("n_molecules")).alias("acyclic_share"))


@q("agg_22_quantiles_linear", f"SELECT event_type, {_fl('quantile_cont(value, 0.05)')} AS q05, {_fl('quantile_cont(value, 0.25)')} AS q25, {_fl('quantile_cont(value, 0.5)')} AS q50, {_fl('quantile_cont(value, 0.75)')} AS q75, {_fl('quantile_cont(value, 0.95)')} AS q95 FROM events GROUP BY 1")
def agg_22(t):
    p = quantiles(t.events, "value", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}, ["event_type"])
    return p.select("event_type", *(flat(F.col(n), 6).alias(n) for n in ("q05", "q25", "q50", "q75", "q95")))


@q("agg_23_describe", f"SELECT l_returnflag, count(*) AS n, {_fl('avg(l_extendedprice)', 1)} AS mean, {_fl('stddev_samp(l_extendedprice)', 1)} AS std, {_fl('stddev_pop(l_extendedprice)', 1)} AS std_pop, {_fl('quantile_cont(l_extendedprice, 0.5)', 1)} AS median, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, {_fl('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 1)} AS iqr FROM lineitem GROUP BY 1")
def agg_23(t):
    x = F.col("l_extendedprice")
    p = quantiles(t.lineitem.select("l_returnflag", x), "l_extendedprice", {"p1": 0.25, "p2": 0.5, "p3": 0.75}, ["l_returnflag"])
    a = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.stddev_pop(x).alias("sp"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return a.join(p, "l_returnflag", "left").select("l_returnflag", "n", flat(F.col("m"), 1).alias("mean"), flat(F.col("s"), 1).alias("std"), flat(F.col("sp"), 1).alias("std_pop"), flat(F.col("p2"), 1).alias("median"), "lo", "hi", flat(F.col("p3") - F.col("p1"), 1).alias("iqr"))


@q("agg_24_all_pseudo_group", f"SELECT coalesce(event_type, 'ALL') AS grp, count(*) AS n, {_fl('avg(value)', 4)} AS mean FROM events GROUP BY ROLLUP (event_type)")
def agg_24(t):
    return t.events.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), flat(F.avg("value"), 4).alias("mean")).select(F.coalesce("event_type", F.lit("ALL")).alias("grp"), "n", "mean")


@q("agg_25_binned_histogram", "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS bin, count(*) AS n_molecules FROM (SELECT molregno, count(*) AS n FROM activities WHERE molregno IS NOT NULL GROUP BY 1) GROUP BY 1")
def agg_25(t):
    c = t.activities.filter("molregno IS NOT NULL").groupBy("molregno").agg(F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise(">20")
    return c.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_molecules"))


_ST, _TO, _AC = "l_discount >= 0.05", "l_discount >= 0.03", "l_quantity >= 25"
_ROLL = {
    "n_rows": "count(*)",
    "n_strict": f"count(CASE WHEN {_ST} THEN 1 END)",
    "n_tolerant": f"count(CASE WHEN {_TO} THEN 1 END)",
    "n_strict_active": f"count(CASE WHEN {_ST} AND {_AC} THEN 1 END)",
    "n_tolerant_active": f"count(CASE WHEN {_TO} AND {_AC} THEN 1 END)",
    "mean_strict": f"avg(CASE WHEN {_ST} THEN l_quantity END)",
    "max_all": "max(l_quantity)",
    "max_strict": f"max(CASE WHEN {_ST} THEN l_quantity END)",
    "min_strict": f"min(CASE WHEN {_ST} THEN l_quantity END)",
    "n_above": "count(CASE WHEN l_quantity >= 40 THEN 1 END)",
    "n_above_outside": f"count(CASE WHEN l_quantity >= 40 AND NOT {_ST} THEN 1 END)",
    "n_high": f"count(CASE WHEN {_ST} AND l_tax <= 0.02 THEN 1 END)",
    "n_medium": f"count(CASE WHEN {_ST} AND l_tax > 0.02 AND l_tax <= 0.05 THEN 1 END)",
    "n_low": f"count(CASE WHEN {_ST} AND l_tax > 0.05 THEN 1 END)",
}
_ORDER = "l_quantity, l_extendedprice, l_orderkey, l_linenumber"


@q(
    "agg_26_rollup_measures",
    f"""WITH g AS (SELECT l_suppkey, l_returnflag, {', '.join(f'{v} AS {k}' for k, v in _ROLL.items())}, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT CASE WHEN {_ST} THEN l_partkey END) AS n_parts_strict,
  quantile_cont(CASE WHEN {_ST} THEN l_quantity END, 0.5) AS median_strict, arg_max(struct_pack(a := l_partkey, b := l_extendedprice, c := l_discount), CASE WHEN {_ST} THEN struct_pack({', '.join(f'{c} := {c}' for c in _ORDER.split(', '))}) END) AS top
  FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, n_rows, n_parts, n_parts_strict, n_strict, n_tolerant, n_strict_active, n_tolerant_active, {_fl('CASE WHEN n_strict > 0 THEN n_strict_active::DOUBLE / n_strict END')} AS strict_active_share,
  {_fl('CASE WHEN n_tolerant > 0 THEN n_tolerant_active::DOUBLE / n_tolerant END')} AS tolerant_active_share, {_fl('mean_strict')} AS mean_strict, median_strict, max_all, max_strict, min_strict, n_above, n_above_outside, {_fl('n_strict::DOUBLE / n_rows')} AS coverage,
  coalesce(top.a::VARCHAR, 'none') AS top_part, top.b AS top_price, top.c AS top_discount, 'HIGH=' || n_high || ', MED=' || n_medium || ', LOW=' || n_low AS confidence FROM g""",
)
def agg_26(t):
    """Over twenty measures of a group in one pass; distinct parts are counted apart, over the same grouping, so that rows are not expanded."""
    keys = ["l_suppkey", "l_returnflag"]
    strict = F.expr(_ST)
    order = F.struct(*_ORDER.split(", "))
    g = t.lineitem.groupBy(*keys).agg(*(F.expr(v).alias(k) for k, v in _ROLL.items()), F.percentile(F.when(strict, F.col("l_quantity")), F.lit(0.5)).alias("median_strict"), F.max(F.when(strict, F.struct(order.alias("o"), "l_partkey", "l_extendedprice", "l_discount"))).alias("top"))
    parts = t.lineitem.groupBy(*keys, "l_partkey").agg(F.max(strict).alias("s")).groupBy(*keys).agg(F.count("l_partkey").alias("n_parts"), F.count(F.when(F.col("s"), F.col("l_partkey"))).alias("n_parts_strict"))
    out = g.join(parts, keys)
    share = lambda a, b: flat(safe_ratio(F.col(a), F.col(b)), 6)
    return out.select(
        *keys, "n_rows", "n_parts", "n_parts_strict", "n_strict", "n_tolerant", "n_strict_active", "n_tolerant_active", share("n_strict_active", "n_strict").alias("strict_active_share"), share("n_tolerant_active", "n_tolerant").alias("tolerant_active_share"), flat(F.col("mean_strict"), 6).alias("mean_strict"),
        "median_strict", "max_all", "max_strict", "min_strict", "n_above", "n_above_outside", share("n_strict", "n_rows").alias("coverage"), F.coalesce(F.col("top.l_partkey").cast("string"), F.lit("none")).alias("top_part"), F.col("top.l_extendedprice").alias("top_price"), F.col("top.l_discount").alias("top_discount"),
        F.format_string("HIGH=%d, MED=%d, LOW=%d", "n_high", "n_medium", "n_low").alias("confidence"),
    )


@q("agg_27_summary_string", "SELECT l_suppkey, 'A=' || count(*) FILTER (WHERE l_returnflag = 'A') || ', N=' || count(*) FILTER (WHERE l_returnflag = 'N') || ', R=' || count(*) FILTER (WHERE l_returnflag = 'R') AS summary FROM lineitem GROUP BY 1")
def agg_27(t):
    c = [F.count(F.when(F.col("l_returnflag") == x, 1)) for x in "ANR"]
    return t.lineitem.groupBy("l_suppkey").agg(F.format_string("A=%d, N=%d, R=%d", *c).alias("summary"))


@q("agg_28_counts_and_percent", f"WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_orderstatus, n, {_fl('n * 100.0::DOUBLE / sum(n) OVER ()', 2)} AS pct, {_fl('m', 2)} AS mean_price FROM g")
def agg_28(t):
    g = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    whole = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(whole).select("o_orderstatus", "n", flat(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"), flat(F.col("m"), 2).alias("mean_price"))


@q("agg_29_pivot_counts", "SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_29(t):
    j = t.orders.select("o_custkey", "o_orderstatus").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@q("agg_30_top3_names", "WITH r AS (SELECT l_suppkey, p_name, max(l_extendedprice) AS best FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY best DESC, p_name) AS i FROM r) SELECT l_suppkey, string_agg(p_name, ' / ' ORDER BY i) AS top3 FROM i WHERE i <= 3 GROUP BY 1")
def agg_30(t):
    r = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("best"))
    r = r.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.max("best").alias("best"))
    i = r.withColumn("i", F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("best"), "p_name"))).filter("i <= 3")
    return i.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p_name"))), lambda x: x["p_name"]), " / ").alias("top3"))


@q("agg_31_crosstab_percent", f"SELECT o_orderpriority, {_fl('count(*) FILTER (WHERE o_orderstatus = $$F$$) * 100.0::DOUBLE / count(*)', 4)} AS pct_f, {_fl('count(*) FILTER (WHERE o_orderstatus = $$O$$) * 100.0::DOUBLE / count(*)', 4)} AS pct_o FROM orders GROUP BY 1")
def agg_31(t):
    n = F.count(F.lit(1))
    one = lambda v: flat(F.count(F.when(F.col("o_orderstatus") == v, 1)) * 100.0 / n, 4)
    return t.orders.groupBy("o_orderpriority").agg(one("F").alias("pct_f"), one("O").alias("pct_o"))


@q("agg_34_key_variants", r"WITH k AS (SELECT name, lower(trim(regexp_replace(nfc_normalize(name), '[\s\x{00A0}]+', ' ', 'g'))) AS key FROM names WHERE name IS NOT NULL) SELECT key, count(*) AS n_rows, string_agg(DISTINCT name, ' | ' ORDER BY name) AS variants, count(DISTINCT name) AS n_variants, count(DISTINCT name) > 1 AS review FROM k GROUP BY 1")
def agg_34(t):
    from ..functions.text import name_key

    k = t.names.filter("name IS NOT NULL").select("name", name_key(F.col("name")).alias("key"))
    spellings = k.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))  # repeats are counted before spellings are gathered
    one = spellings.groupBy("key").agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("variants"), F.count(F.lit(1)).alias("n_variants"))
    return one.withColumn("review", F.col("n_variants") > 1)


@q("agg_35_frequent_unresolved", "SELECT lower(trim(name)) AS key, count(*) AS n_rows, count(DISTINCT file_path) AS n_files FROM names WHERE name IS NOT NULL AND (status = 404 OR len(coalesce(cids, [])) = 0) GROUP BY 1 HAVING count(*) >= 2")
def agg_35(t):
    none = (F.col("status") == 404) | (F.coalesce(F.size("cids"), F.lit(0)) <= 0)
    return t.names.filter("name IS NOT NULL").filter(none).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file_path").alias("n_files")).filter("n_rows >= 2")


@q("agg_36_one_versus_many", "SELECT count(*) FILTER (WHERE n = 1) AS n_single, count(*) FILTER (WHERE n > 1) AS n_many FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def agg_36(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    return n.agg(F.count(F.when(F.col("n") == 1, 1)).alias("n_single"), F.count(F.when(F.col("n") > 1, 1)).alias("n_many"))


@q("agg_38_id_gaps", "SELECT v + 1 AS first_missing, w - 1 AS last_missing FROM (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM (SELECT DISTINCT molregno AS v FROM compound_structures)) WHERE w > v + 1")
def agg_38(t):
    from ..operators.ranking import gaps

    return gaps(t.compound_structures, "molregno")


@q("agg_39_name_groups")
def agg_39(t):
    from ..operators.variants import variant_groups

    return variant_groups(t.names.filter("name IS NOT NULL").select(F.explode("cids").alias("cid"), F.lower(F.trim("name")).alias("n")), "cid", "n")


@q("agg_40_two_population_profile", f"SELECT natural_product, count(*) AS n, {_fl('avg(molecular_weight)', 4)} AS mean_weight, {_fl('stddev_pop(molecular_weight)', 4)} AS std_weight, {_fl('quantile_cont(molecular_weight, 0.5)', 4)} AS median_weight FROM compound_structures WHERE natural_product IS NOT NULL AND molecular_weight IS NOT NULL AND NOT isnan(molecular_weight) GROUP BY 1")
def agg_40(t):
    x = F.col("molecular_weight")
    s = t.compound_structures.filter("natural_product IS NOT NULL AND molecular_weight IS NOT NULL AND NOT isnan(molecular_weight)")
    g = s.groupBy("natural_product").agg(F.count(F.lit(1)).alias("n"), flat(F.avg(x), 4).alias("mean_weight"), flat(F.stddev_pop(x), 4).alias("std_weight"))
    m = quantiles(s.select("natural_product", x), "molecular_weight", {"m": 0.5}, ["natural_product"])
    return g.join(m, "natural_product").select("natural_product", "n", "mean_weight", "std_weight", flat(F.col("m"), 4).alias("median_weight"))


@q("agg_41_content_hash", hash_sql("region", "r_regionkey || ':' || r_name"))
def agg_41(t):
    return content_hash(t.region, F.concat_ws(":", F.col("r_regionkey").cast("string"), "r_name"))


@q("agg_33_reconciliation", "SELECT (SELECT count(*) FROM lineitem) AS n_in, (SELECT count(*) FROM lineitem WHERE l_quantity >= 10) AS n_kept, (SELECT count(*) FROM lineitem WHERE NOT l_quantity >= 10 OR l_quantity IS NULL) AS n_dropped, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphans, true AS balanced")
def agg_33(t):
    keep = F.coalesce(F.col("l_quantity") >= 10, F.lit(False))
    c = t.lineitem.agg(F.count(F.lit(1)).alias("n_in"), n_if(keep).alias("n_kept"), n_if(~keep).alias("n_dropped"))
    o = t.lineitem.select("l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    return c.crossJoin(o).withColumn("balanced", F.col("n_in") == F.col("n_kept") + F.col("n_dropped"))


QUERIES, SQL = plan.queries, plan.sql
