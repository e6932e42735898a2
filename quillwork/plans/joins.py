"""Joins and set operations (JOI, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sorted_set
from ..functions.text import layer_key
from ..operators import joins as op
from ..operators import labels
from .filters import STRICT, USABLE
from .registry import Plan

plan = Plan()
q = plan.add
_LAYER = r"CASE WHEN regexp_matches(coalesce(inchikey_connectivity, ''), '[\p{L}\p{N}]') THEN upper(regexp_replace(inchikey_connectivity, '^\s+|\s+$', '', 'g')) END"
_MAP = f"(SELECT molregno, min({_LAYER}) AS layer FROM compound_bioactivity_raw WHERE molregno IS NOT NULL GROUP BY 1)"


@q("joi_01_keyset_dictionary", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01') ON l_orderkey = o_orderkey")
def joi_01(t):
    keys = t.orders.filter("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'").select("o_orderkey", "o_orderpriority")
    return t.lineitem.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@q("joi_02_inner_two_left", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def joi_02(t):
    o = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    p = t.part.filter("p_size > 10").select("p_partkey", "p_brand")
    s = t.supplier.filter("s_acctbal > 0").select("s_suppkey", "s_name")
    x = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return x.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@q("joi_03_chain_distinct", "SELECT DISTINCT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def joi_03(t):
    big = t.orders.filter("o_totalprice > 200000").select("o_custkey").distinct()
    c = t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_nationkey", "c_mktsegment").distinct()
    return c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "c_mktsegment").distinct()


@q("joi_04_three_way_left", f"SELECT a.activity_id, a.loaded_at, s.pref_name, d.n AS n_documents FROM activities a JOIN compound_structures s USING (molregno) LEFT JOIN (SELECT plant_index::BIGINT AS p, count(*) AS n FROM documents GROUP BY 1) d ON d.p = a.tid WHERE {STRICT.replace('tid', 'a.tid')}")
def joi_04(t):
    a = t.activities.filter(labels.strict()).select("activity_id", "loaded_at", "molregno", "tid")
    d = t.documents.groupBy(F.col("plant_index").cast("bigint").alias("p")).agg(F.count(F.lit(1)).alias("n_documents"))
    return a.join(t.compound_structures.select("molregno", "pref_name"), "molregno").join(d, F.col("p") == F.col("tid"), "left").select("activity_id", "loaded_at", "pref_name", "n_documents")


@q("joi_05_lookup_inner", f"SELECT molregno, layer, chembl_id FROM {_MAP} JOIN compound_structures USING (molregno) WHERE layer IS NOT NULL")
def joi_05(t):
    m = t.compound_bioactivity_raw.filter("molregno IS NOT NULL").groupBy("molregno").agg(F.min(layer_key(F.col("inchikey_connectivity"))).alias("layer")).filter("layer IS NOT NULL")
    return m.join(t.compound_structures.select("molregno", "chembl_id"), "molregno")


@q("joi_06_row_preserving_lookup", "SELECT e.event_id, coalesce(f.first_value, -1) AS first_value FROM events e LEFT JOIN (SELECT user_id, event_type, arg_min(value, event_id) AS first_value FROM events WHERE value > 50 GROUP BY ALL) f USING (user_id, event_type)")
def joi_06(t):
    e = t.events
    right = e.filter("value > 50").select("user_id", "event_type", F.col("value").alias("first_value"), F.col("event_id").alias("o"))
    return op.lookup(e.select("event_id", "user_id", "event_type"), right, ["user_id", "event_type"], [F.col("o")], {"first_value": F.lit(-1.0)}).select("event_id", "first_value")


@q("joi_07_left_other_names", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def joi_07(t):
    n = t.nation.filter("n_regionkey = 1")
    return t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@q("joi_08_composite_inner", "SELECT a.user_id, a.event_type, a.n AS n_all, b.n AS n_high FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 80 GROUP BY ALL) b USING (user_id, event_type)")
def joi_08(t):
    k = ["user_id", "event_type"]
    a = t.events.groupBy(*k).agg(F.count(F.lit(1)).alias("n_all"))
    b = t.events.filter("value > 80").groupBy(*k).agg(F.count(F.lit(1)).alias("n_high"))
    return a.join(b, k)


@q("joi_09_three_key_suffix", "SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.q AS quantity_x, b.q AS quantity_y FROM (SELECT l_orderkey, l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.04 GROUP BY ALL) b USING (l_orderkey, l_partkey, l_suppkey)")
def joi_09(t):
    k = ["l_orderkey", "l_partkey", "l_suppkey"]
    a = t.lineitem.filter("l_returnflag = 'R'").groupBy(*k).agg(F.max("l_quantity").alias("quantity_x"))
    b = t.lineitem.filter("l_linestatus = 'F' AND l_tax > 0.04").groupBy(*k).agg(F.max("l_quantity").alias("quantity_y"))
    return a.join(b, k, "left")


@q("joi_10_semi", f"SELECT DISTINCT molregno FROM activities WHERE {USABLE} AND molregno IN (SELECT molregno FROM compound_structures WHERE natural_product = 1)")
def joi_10(t):
    return t.activities.filter(labels.usable()).select("molregno").join(t.compound_structures.filter("natural_product = 1").select("molregno"), "molregno", "left_semi").distinct()


@q("joi_11_anti", "SELECT molregno FROM compound_structures WHERE NOT EXISTS (SELECT 1 FROM split_draft d WHERE d.molregno = compound_structures.molregno)")
def joi_11(t):
    return t.compound_structures.select("molregno").join(t.split_draft.select("molregno"), "molregno", "left_anti")


@q("joi_12_map_last_wins", "SELECT s.molregno, coalesce(d.split_name, 'unassigned') AS split_name FROM compound_structures s LEFT JOIN (SELECT molregno, max(struct_pack(a := assigned_at, s := coalesce(split_name, ''))).s AS split_name FROM split_draft GROUP BY 1) d USING (molregno)")
def joi_12(t):
    last = t.split_draft.groupBy("molregno").agg(F.max(F.struct("assigned_at", F.coalesce("split_name", F.lit("")).alias("s"))).alias("m")).select("molregno", F.col("m.s").alias("split_name"))
    return t.compound_structures.select("molregno").join(last, "molregno", "left").select("molregno", F.coalesce("split_name", F.lit("unassigned")).alias("split_name"))


@q("joi_13_tuple_membership", "SELECT DISTINCT a.molregno, a.tid FROM activities a WHERE (a.molregno, a.tid) IN (SELECT molregno, tid FROM activities WHERE pchembl_value >= 8 AND NOT isnan(pchembl_value) AND molregno IS NOT NULL AND tid IS NOT NULL) AND a.standard_type = 'Ki'")
def joi_13(t):
    strong = t.activities.filter("pchembl_value >= 8 AND NOT isnan(pchembl_value)").select("molregno", "tid")
    return t.activities.filter("standard_type = 'Ki'").select("molregno", "tid").join(strong, ["molregno", "tid"], "left_semi").distinct()


@q("joi_14_positional_check", "WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) i FROM supplier), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name) i FROM supplier) SELECT count(*) AS n, count(*) FILTER (WHERE a.s_name IS DISTINCT FROM b.s_name) AS n_mismatch FROM a JOIN b USING (i)")
def joi_14(t):
    from ..operators.identity import with_row_id

    a = with_row_id(t.supplier.select("s_suppkey", F.col("s_name").alias("a")), "s_suppkey")
    b = with_row_id(t.supplier.select(F.col("s_name").alias("b")), "b")
    return a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("a").eqNullSafe(F.col("b")), 1).otherwise(0)).cast("bigint").alias("n_mismatch"))


@q("joi_15_override_first", "SELECT p_partkey, coalesce(o.size_class, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 15 THEN 'medium' ELSE 'small' END) AS size_class, o.size_class IS NOT NULL AS from_override FROM part LEFT JOIN (SELECT p_partkey, 'special' AS size_class FROM part WHERE p_retailprice > 1500) o USING (p_partkey)")
def joi_15(t):
    p = t.part
    o = p.filter("p_retailprice > 1500").select("p_partkey", F.lit("special").alias("size_class"))
    rule = F.when(F.col("p_size") >= 40, "large").when(F.col("p_size") >= 15, "medium").otherwise("small")
    return op.override(p, o, "p_partkey", rule, "size_class").select("p_partkey", "size_class", "from_override")


@q("joi_16_fan_out_any", f"SELECT layer, count(*) AS n_rows, bool_or({STRICT}) AS any_strict, coalesce(array_to_string(list_sort(list_distinct(list(target_chembl_id) FILTER (WHERE target_chembl_id IS NOT NULL))), '|'), '') AS targets FROM activities JOIN {_MAP} USING (molregno) WHERE layer IS NOT NULL AND {USABLE} GROUP BY 1")
def joi_16(t):
    m = t.compound_bioactivity_raw.filter("molregno IS NOT NULL").groupBy("molregno").agg(F.min(layer_key(F.col("inchikey_connectivity"))).alias("layer")).filter("layer IS NOT NULL")
    one = t.activities.filter(labels.usable()).groupBy("molregno", "target_chembl_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(labels.strict(), F.lit(False))).alias("s"))
    return one.join(m, "molregno").groupBy("layer").agg(F.sum("n").alias("n_rows"), F.bool_or("s").alias("any_strict"), sorted_set(F.col("target_chembl_id")).alias("targets"))


_POINTS = "SELECT vec_id, floor(embedding[1]::DOUBLE * 40) AS x, floor(embedding[2]::DOUBLE * 40) AS y, floor(embedding[3]::DOUBLE * 40) AS z, label FROM embeddings"


@q("joi_19_radius", f"WITH p AS ({_POINTS}) SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = 0 AND b.label = 1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 9")
def joi_19(t):
    xyz = [F.floor(F.element_at("embedding", i + 1).cast("double") * 40).cast("double").alias(c) for i, c in enumerate("xyz")]
    p = t.embeddings.select("vec_id", "label", *xyz)
    return op.radius_join(p.filter("label = 0"), p.filter("label = 1"), 3.0).select(F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"))


@q("joi_21_shared_reference", "WITH a AS (SELECT DISTINCT molregno, doc_id FROM activities WHERE pchembl_value >= 7 AND NOT isnan(pchembl_value) AND molregno IS NOT NULL), b AS (SELECT DISTINCT molregno, doc_id FROM activities WHERE pchembl_value < 5 AND molregno IS NOT NULL) SELECT molregno, max(CASE WHEN b.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS shares_reference FROM a LEFT JOIN b USING (molregno, doc_id) GROUP BY 1")
def joi_21(t):
    a = t.activities.filter("pchembl_value >= 7 AND NOT isnan(pchembl_value) AND molregno IS NOT NULL").select("molregno", "doc_id").distinct()
    b = t.activities.filter("pchembl_value < 5 AND molregno IS NOT NULL").select("molregno", "doc_id").distinct().withColumn("hit", F.lit(True))
    return a.join(b, ["molregno", "doc_id"], "left").groupBy("molregno").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("shares_reference"))


@q("joi_22_leakage_counts", "SELECT (SELECT count(DISTINCT molregno) FROM split_draft WHERE lower(trim(split_name)) LIKE 'tr%') AS n_a, (SELECT count(DISTINCT molregno) FROM split_draft WHERE lower(trim(split_name)) LIKE 'te%') AS n_b, (SELECT count(*) FROM (SELECT molregno FROM split_draft WHERE lower(trim(split_name)) LIKE 'tr%' INTERSECT SELECT molregno FROM split_draft WHERE lower(trim(split_name)) LIKE 'te%')) AS n_both")
def joi_22(t):
    name = F.lower(F.trim("split_name"))
    return op.overlap_counts(t.split_draft.filter(name.startswith("tr")), t.split_draft.filter(name.startswith("te")), "molregno").select("n_a", "n_b", "n_both")


@q("joi_23_small_cross", "SELECT r_name, threshold, count(*) FILTER (WHERE c_acctbal >= threshold) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0), (5000), (9000)) v(threshold) GROUP BY ALL")
def joi_23(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    wide = c.groupBy("r_name").agg(*(F.count(F.when(F.col("c_acctbal") >= v, 1)).alias(f"n{v}") for v in (0, 5000, 9000)))
    return wide.select("r_name", F.explode(F.array(*(F.struct(F.lit(v).alias("threshold"), F.col(f"n{v}").alias("n")) for v in (0, 5000, 9000)))).alias("s")).select("r_name", "s.threshold", "s.n")


@q("set_01_union_all", "SELECT molregno, 'structure' AS origin FROM compound_structures UNION ALL SELECT molregno, 'draft' FROM split_draft")
def set_01(t):
    return t.compound_structures.select("molregno", F.lit("structure").alias("origin")).unionByName(t.split_draft.select("molregno", F.lit("draft").alias("origin")))


@q("set_02_union_distinct", "SELECT molregno FROM compound_structures UNION SELECT molregno FROM activities")
def set_02(t):
    return t.compound_structures.select("molregno").union(t.activities.select("molregno")).distinct()


@q("set_03_intersect", "SELECT molregno FROM compound_structures INTERSECT SELECT molregno FROM activities")
def set_03(t):
    return t.compound_structures.select("molregno").intersect(t.activities.select("molregno"))


@q("set_04_difference", "SELECT molregno FROM compound_structures EXCEPT SELECT molregno FROM split_draft")
def set_04(t):
    return t.compound_structures.select("molregno").subtract(t.split_draft.select("molregno"))


@q("set_05_equality", "SELECT (SELECT count(*) FROM (SELECT inchikey_connectivity FROM compounds_unique EXCEPT SELECT inchikey_connectivity FROM compound_vectors)) = 0 AND (SELECT count(*) FROM (SELECT inchikey_connectivity FROM compound_vectors EXCEPT SELECT inchikey_connectivity FROM compounds_unique)) = 0 AS equal")
def set_05(t):
    c = op.overlap_counts(t.compounds_unique, t.compound_vectors, "inchikey_connectivity")
    return c.select(((F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)).alias("equal"))


@q("set_06_prefix_overlap", "WITH a AS (SELECT DISTINCT upper(trim(standard_inchi_key)) AS k FROM compound_structures WHERE length(trim(standard_inchi_key)) = 27), b AS (SELECT DISTINCT inchikey AS k FROM compounds_unique WHERE length(inchikey) = 27) SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS n_full, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b) AND substring(k, 1, 14) IN (SELECT substring(k, 1, 14) FROM b)) AS n_prefix_only")
def set_06(t):
    a = t.compound_structures.filter("length(trim(standard_inchi_key)) = 27").select(F.upper(F.trim("standard_inchi_key")).alias("k")).distinct().withColumn("p", F.substring("k", 1, 14))
    b = t.compounds_unique.filter("length(inchikey) = 27").select(F.col("inchikey").alias("k")).distinct()
    full = a.join(b.withColumn("f", F.lit(1)), "k", "left").join(b.select(F.substring("k", 1, 14).alias("p")).distinct().withColumn("g", F.lit(1)), "p", "left")
    return full.agg(F.count("f").alias("n_full"), F.count(F.when(F.col("f").isNull(), F.col("g"))).alias("n_prefix_only"))


QUERIES, SQL = plan.queries, plan.sql
