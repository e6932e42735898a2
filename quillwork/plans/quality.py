"""Integrity and review (INT, CAS without business rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as fn
from ..operators import quality as op
from ..operators.identity import first_seen
from ..sources import tables
from .registry import Plan, hash_sql

plan = Plan()
q = plan.add


@q("int_02_upstream_hash_table", "SELECT n_nationkey, sha256(n_name) AS expected, sha256(upper(n_name) || '*') AS actual FROM nation WHERE n_regionkey = 3")
def int_02(t):
    want = t.nation.select("n_nationkey", F.sha2("n_name", 256).alias("h"))
    have = t.nation.select("n_nationkey", F.sha2(F.when(F.col("n_regionkey") == 3, F.concat(F.upper("n_name"), F.lit("*"))).otherwise(F.col("n_name")), 256).alias("h"))
    return op.mismatches(want, have, "n_nationkey", "h")


@q("int_03_population_checks", "SELECT * FROM (SELECT 'key present' AS \"check\", count(*) FILTER (WHERE molregno IS NULL) AS n_violations FROM activities UNION ALL SELECT 'measure in range', count(*) FILTER (WHERE NOT coalesce(pchembl_value > 0 AND pchembl_value < 15, false)) FROM activities UNION ALL SELECT 'flag is binary', count(*) FILTER (WHERE NOT coalesce(potential_duplicate IN (0, 1), false)) FROM activities UNION ALL SELECT 'unique activity_id', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM activities GROUP BY activity_id))")
def int_03(t):
    checks = {"key present": F.col("molregno").isNotNull(), "measure in range": (F.col("pchembl_value") > 0) & (F.col("pchembl_value") < 15), "flag is binary": F.col("potential_duplicate").isin(0, 1)}
    return op.violations(t.activities, checks, ["activity_id"])


@q("int_04_output_checks", "SELECT 'every line has its order' AS \"check\", (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_violations UNION ALL SELECT 'every order has its customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'discount in range', (SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 1))")
def int_04(t):
    orphan = lambda a, k, b, j: a.select(F.col(k).alias("k")).join(b.select(F.col(j).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n_violations"))
    one = orphan(t.lineitem, "l_orderkey", t.orders, "o_orderkey").select(F.lit("every line has its order").alias("check"), "n_violations")
    two = orphan(t.orders, "o_custkey", t.customer, "c_custkey").select(F.lit("every order has its customer").alias("check"), "n_violations")
    return one.unionByName(two).unionByName(op.violations(t.lineitem, {"discount in range": F.col("l_discount").between(0, 1)}))


@q("int_05_double_run", hash_sql("(SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY 1)", "concat_ws(':', o_custkey, n, m)", ", true AS same"))
def int_05(t):
    build = lambda: t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m"))
    return op.double_run(build, F.concat_ws(":", *(F.col(c).cast("string") for c in ("o_custkey", "n", "m"))))


@q("int_06_map_validation", "SELECT 'name present' AS \"check\", (SELECT count(*) FROM plant_index WHERE NOT coalesce(length(trim(scientific_name)) > 0, false)) AS n_violations UNION ALL SELECT 'index positive', (SELECT count(*) FROM plant_index WHERE NOT plant_index > 0) UNION ALL SELECT 'unique plant_index', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM plant_index GROUP BY plant_index))")
def int_06(t):
    return op.violations(t.plant_index, {"name present": F.length(F.trim("scientific_name")) > 0, "index positive": F.col("plant_index") > 0}, ["plant_index"])


@q("int_07_idempotency", "SELECT count(*) AS n, 0::BIGINT AS n_changed FROM plant_index WHERE scientific_name IS NOT NULL")
def int_07(t):
    return op.idempotent(t.plant_index, "scientific_name", fn.species_key)


@q("int_08_manifest_check", "SELECT s_suppkey, s_name AS expected, NULL::VARCHAR AS actual FROM supplier WHERE s_acctbal < 0")
def int_08(t):
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    return op.mismatches(s, s.filter("s_acctbal >= 0"), "s_suppkey", "s_name")


@q("int_01_hash_gate", hash_sql("orders", "concat_ws(':', o_orderkey, o_custkey, o_orderstatus)", ", true AS unchanged, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_stage"))
def int_01(t):
    """The input of a stage, hashed before and after it runs."""
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
    return op.hash_gate(lambda: t.orders, line, lambda d: d.filter("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n_stage")))


@q("cas_06_review_queue", r"SELECT record_id, flags FROM (SELECT record_id, array_to_string(list_filter([CASE WHEN len(coalesce(cids, [])) < 1 THEN 'missing_id' END, CASE WHEN contains(name, '?') THEN 'uncertain_name' END, CASE WHEN length(trim(name)) < 4 THEN 'very_short_name' END, CASE WHEN regexp_matches(name, '-\s+') THEN 'spacing_anomaly' END], lambda x: x IS NOT NULL), ';') AS flags FROM names) WHERE flags <> ''")
def cas_06(t):
    return t.names.select("record_id", fn.quality_flags(F.col("name"), F.col("cids")).alias("flags")).filter("flags <> ''")


@q("cas_07_source_dedupe", "SELECT target_chembl_id, doc_id, min(activity_id) AS first_activity FROM activities WHERE doc_id IS NOT NULL AND target_chembl_id IS NOT NULL AND activity_id IS NOT NULL GROUP BY ALL")
def cas_07(t):
    a = t.activities.filter("doc_id IS NOT NULL AND target_chembl_id IS NOT NULL AND activity_id IS NOT NULL").select("target_chembl_id", "doc_id", F.col("activity_id").alias("first_activity"))
    return first_seen(a, [F.col("target_chembl_id"), F.col("doc_id")], [F.col("first_activity")])


_USABLE = "standard_relation = '=' AND pchembl_value IS NOT NULL AND NOT isnan(pchembl_value) AND molregno IS NOT NULL"


@q("cas_03_evidence_cascade", f"""WITH kb AS (SELECT DISTINCT molregno FROM compound_bioactivity_raw WHERE is_strict AND molregno IS NOT NULL AND pchembl_value >= 8),
  exact AS (SELECT molregno, max(pchembl_value) AS best, count(*) AS n FROM activities WHERE {_USABLE} AND target_type = 'SINGLE PROTEIN' GROUP BY 1),
  related AS (SELECT molregno, max(pchembl_value) AS best, count(*) AS n FROM activities WHERE {_USABLE} AND target_type IN ('PROTEIN COMPLEX', 'CELL-LINE', 'ORGANISM') GROUP BY 1)
SELECT s.molregno, CASE WHEN kb.molregno IS NOT NULL THEN 'known' WHEN e.best >= 6 THEN 'supported' WHEN e.best >= 5 THEN 'partly supported' WHEN e.best IS NOT NULL THEN 'contradicted' WHEN r.best IS NOT NULL THEN 'related target only' ELSE 'no report' END AS evidence,
  CASE WHEN kb.molregno IS NOT NULL THEN 1 WHEN e.n IS NOT NULL THEN e.n WHEN r.n IS NOT NULL THEN r.n ELSE 0 END AS n_reports FROM compound_structures s LEFT JOIN kb USING (molregno) LEFT JOIN exact e USING (molregno) LEFT JOIN related r USING (molregno)""")
def cas_03(t):
    kb = t.compound_bioactivity_raw.filter("is_strict AND molregno IS NOT NULL AND pchembl_value >= 8").select("molregno").distinct()
    usable = t.activities.filter(_USABLE)
    kind = F.when(F.col("target_type") == "SINGLE PROTEIN", "exact").when(F.col("target_type").isin("PROTEIN COMPLEX", "CELL-LINE", "ORGANISM"), "related")
    one = usable.select("molregno", "pchembl_value", kind.alias("kind")).groupBy("molregno")  # both tiers in one pass
    best = one.agg(*(f(F.when(F.col("kind") == k, F.col("pchembl_value"))).alias(f"{k}_{n}") for k in ("exact", "related") for n, f in (("best", F.max), ("n", F.count))))
    return op.evidence_cascade(t.compound_structures.select("molregno"), kb, best, "molregno")


@q("cas_05_confusion_status", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_discount * 7 + l_tax * 3) >= 0.5 AS p, CASE WHEN l_linestatus = 'F' THEN l_returnflag = 'R' END AS y FROM lineitem) SELECT CASE WHEN y IS NULL THEN 'unlabelled' WHEN p AND y THEN 'TP' WHEN p THEN 'FP' WHEN y THEN 'FN' ELSE 'TN' END AS status, count(*) AS n FROM x GROUP BY 1")
def cas_05(t):
    p, y = (F.col("l_discount") * 7 + F.col("l_tax") * 3) >= 0.5, F.when(F.col("l_linestatus") == "F", F.col("l_returnflag") == "R")
    x = t.lineitem.select(p.alias("p"), y.alias("y"))
    return x.groupBy(F.when(F.col("y").isNull(), "unlabelled").when(F.col("p") & F.col("y"), "TP").when(F.col("p"), "FP").when(F.col("y"), "FN").otherwise("TN").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@q("cas_01_match_typing", "SELECT CASE WHEN status >= 500 THEN 'fetch_error' WHEN status = 404 OR len(coalesce(cids, [])) = 0 THEN 'no_match' WHEN len(cids) = 1 THEN 'exact_match' ELSE 'multiple_matches' END AS match_type, count(*) AS n FROM names GROUP BY 1")
def cas_01(t):
    return t.names.groupBy(tables.match_type(F.col("status"), F.col("cids")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


@q("cas_10_ledger_states", "SELECT file_path, CASE WHEN bool_or(status >= 500) THEN 'failed' WHEN bool_or(len(coalesce(cids, [])) > 0) THEN 'has results' WHEN bool_and(name IS NULL AND status IS NULL) THEN 'empty' ELSE 'no results' END AS state FROM names GROUP BY 1")
def cas_10(t):
    some = F.coalesce(F.size("cids"), F.lit(0)) > 0
    state = F.when(F.bool_or(F.coalesce(F.col("status") >= 500, F.lit(False))), "failed").when(F.bool_or(some), "has results").when(F.bool_and(F.col("name").isNull() & F.col("status").isNull()), "empty").otherwise("no results")
    return t.names.groupBy("file_path").agg(state.alias("state"))


@q("cas_11_review_flag", "SELECT molregno, coalesce(natural_product = 0, false) OR coalesce(molecular_weight > 700, false) AS review FROM compound_structures WHERE molecular_weight IS NULL OR NOT isnan(molecular_weight)")
def cas_11(t):
    s = t.compound_structures.filter("molecular_weight IS NULL OR NOT isnan(molecular_weight)")
    return s.select("molregno", (F.coalesce(F.col("natural_product") == 0, F.lit(False)) | F.coalesce(F.col("molecular_weight") > 700, F.lit(False))).alias("review"))


QUERIES, SQL = plan.queries, plan.sql
