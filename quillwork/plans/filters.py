"""Projections, predicates and funnels (PRJ, FIL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import first_filled, flat, n_if
from ..functions.names import NONSPECIFIC, nonspecific
from ..functions.text import connectivity, filled
from ..operators import labels
from ..operators.identity import with_row_id
from ..operators.prefix import quantiles
from .registry import Plan

plan = Plan()
q = plan.add

USABLE = "(standard_relation = '=' AND standard_value IS NOT NULL AND standard_units = 'nM' AND standard_type IN ('IC50','Ki','Kd','EC50') AND potential_duplicate = 0 AND (data_validity_comment IS NULL OR data_validity_comment = ''))"
STRICT = f"({USABLE} AND assay_type IN ('B','F') AND confidence_score IN (8,9) AND tid IS NOT NULL)"
POOL = "(standard_relation = '=' AND potential_duplicate = 0 AND data_validity_comment IS NULL AND pchembl_value IS NOT NULL AND NOT isnan(pchembl_value))"
LABELS = f"""SELECT molregno, target_chembl_id, count(pchembl_value) AS n_records, quantile_cont(pchembl_value, 0.5) AS median_value, min(pchembl_value) AS min_value, max(pchembl_value) AS max_value
FROM activities WHERE {POOL} AND molregno IS NOT NULL AND target_chembl_id IS NOT NULL GROUP BY ALL"""
_WIDE = "(min_value < {t} AND max_value >= {t} AND max_value - min_value > 1.0)"


@q("label_table", f"WITH a AS ({LABELS}) SELECT *, {_WIDE.format(t=6)} AS conflict_t6, CASE WHEN NOT {_WIDE.format(t=6)} THEN CASE WHEN median_value >= 6 THEN 1.0::DOUBLE ELSE 0.0 END END AS label_t6, {_WIDE.format(t=5)} AS conflict_t5, CASE WHEN NOT {_WIDE.format(t=5)} THEN CASE WHEN median_value >= 5 THEN 1.0::DOUBLE ELSE 0.0 END END AS label_t5 FROM a")
def label_table(t):
    rows = t.activities.filter(labels.pool() & F.col("molregno").isNotNull() & F.col("target_chembl_id").isNotNull())
    return labels.label_table(rows, ["molregno", "target_chembl_id"], "pchembl_value")


@q("prj_01_connectivity_key", r"SELECT molregno, CASE WHEN regexp_matches(coalesce(standard_inchi_key,''), '[\p{L}\p{N}]') THEN substring(regexp_replace(upper(regexp_replace(standard_inchi_key, '^\s+|\s+$', '', 'g')), '^INCHIKEY=', ''), 1, 14) END AS layer FROM compound_structures")
def prj_01(t):
    return t.compound_structures.select("molregno", connectivity(F.col("standard_inchi_key")).alias("layer"))


@q("prj_02_first_filled", "SELECT inchikey_connectivity, coalesce(nullif(trim(smiles_standardized), ''), nullif(trim(smiles_flat), '')) AS smiles FROM compounds_unique")
def prj_02(t):
    return t.compounds_unique.select("inchikey_connectivity", first_filled(F.col("smiles_standardized"), F.col("smiles_flat")).alias("smiles"))


@q("prj_03_preferred_id", "SELECT record_id, coalesce(try_cast(cids[1] AS BIGINT), try_cast(try_cast(name AS DOUBLE) AS BIGINT), -1) AS preferred_id FROM names")
def prj_03(t):
    first = F.expr("try_cast(try_element_at(cids, 1) AS bigint)")
    return t.names.select("record_id", F.coalesce(first, F.expr("try_cast(try_cast(name AS double) AS bigint)"), F.lit(-1)).alias("preferred_id"))


@q("prj_04_positional_join", "WITH a AS (SELECT plant_index, scientific_name, row_number() OVER (ORDER BY plant_index) AS i FROM plant_index), b AS (SELECT plant_index, family, row_number() OVER (ORDER BY plant_index) AS i FROM plant_index) SELECT a.i AS row_id, scientific_name, family FROM a JOIN b USING (i)")
def prj_04(t):
    a = with_row_id(t.plant_index.select("plant_index", "scientific_name"), "plant_index")
    b = with_row_id(t.plant_index.select("plant_index", "family"), "plant_index")
    return a.join(b.select("row_id", "family"), "row_id").select("row_id", "scientific_name", "family")


@q("prj_05_row_number", "SELECT molregno, row_number() OVER (ORDER BY molregno) AS row_id FROM compound_structures")
def prj_05(t):
    return with_row_id(t.compound_structures.select("molregno"), "molregno")


@q("prj_06_default_fill", "SELECT plant_index, coalesce(synonym, '-') AS synonym, coalesce(family, '-') AS family FROM plant_index")
def prj_06(t):
    return t.plant_index.select("plant_index", F.coalesce("synonym", F.lit("-")).alias("synonym"), F.coalesce("family", F.lit("-")).alias("family"))


@q("prj_07_reference_fallback", "SELECT plant_index, CASE WHEN synonym IS NULL OR trim(synonym) IN ('', '-') THEN source_page_url ELSE synonym END AS reference FROM plant_index")
def prj_07(t):
    missing = F.col("synonym").isNull() | F.trim("synonym").isin("", "-")
    return t.plant_index.select("plant_index", F.when(missing, F.col("source_page_url")).otherwise(F.col("synonym")).alias("reference"))


@q("fil_01_none_of_flags", "SELECT inchikey_connectivity FROM compounds_unique WHERE NOT (coalesce(is_inorganic, false) OR coalesce(has_metal, false) OR coalesce(too_small, false) OR coalesce(too_large, false))")
def fil_01(t):
    bad = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_inorganic", "has_metal", "too_small", "too_large")]
    return t.compounds_unique.filter(~(bad[0] | bad[1] | bad[2] | bad[3])).select("inchikey_connectivity")


@q("fil_02_usable", f"SELECT activity_id, loaded_at, standard_value FROM activities WHERE {USABLE}")
def fil_02(t):
    return t.activities.filter(labels.usable()).select("activity_id", "loaded_at", "standard_value")


@q("fil_03_strict", f"SELECT activity_id, loaded_at, tid FROM activities WHERE {STRICT}")
def fil_03(t):
    return t.activities.filter(labels.strict()).select("activity_id", "loaded_at", "tid")


@q("fil_04_label_pool", f"SELECT activity_id, loaded_at, pchembl_value FROM activities WHERE {POOL}")
def fil_04(t):
    return t.activities.filter(labels.pool()).select("activity_id", "loaded_at", "pchembl_value")


@q("fil_05_name_search", "SELECT DISTINCT target_chembl_id, target_pref_name FROM activities WHERE target_pref_name ILIKE 'g%' OR target_pref_name ILIKE '%kinase%' OR target_pref_name ILIKE '%receptor%'")
def fil_05(t):
    c = F.col("target_pref_name")
    return t.activities.filter(c.ilike("g%") | c.ilike("%kinase%") | c.ilike("%receptor%")).select("target_chembl_id", "target_pref_name").distinct()


@q("fil_06_ablation", f"SELECT count(DISTINCT CASE WHEN {STRICT} THEN molregno END) AS n_strict, count(DISTINCT CASE WHEN {USABLE} AND assay_type IN ('B','F') AND tid IS NOT NULL THEN molregno END) AS n_any_confidence, count(DISTINCT CASE WHEN {USABLE} THEN molregno END) AS n_usable FROM activities")
def fil_06(t):
    loose = labels.usable() & F.col("assay_type").isin("B", "F") & F.col("tid").isNotNull()
    one = lambda c: F.countDistinct(F.when(c, F.col("molregno")))
    return t.activities.agg(one(labels.strict()).alias("n_strict"), one(loose).alias("n_any_confidence"), one(labels.usable()).alias("n_usable"))


@q("fil_07_domain_flags", "SELECT vec_id, CASE WHEN s >= 0.4 THEN 'in' WHEN s >= 0.3 THEN 'near' ELSE 'out' END AS domain FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 4 AS s FROM embeddings)")
def fil_07(t):
    s = F.abs(F.element_at("embedding", 1).cast("double")) * 4
    return t.embeddings.select("vec_id", F.when(s >= 0.4, "in").when(s >= 0.3, "near").otherwise("out").alias("domain"))


@q("fil_08_cutoff_table", "WITH c(event_type, cutoff) AS (SELECT event_type, quantile_cont(value, 0.9) FROM events GROUP BY 1) SELECT event_id, value >= cutoff AS above FROM events JOIN c USING (event_type)")
def fil_08(t):
    cut = quantiles(t.events, "value", {"cutoff": 0.9}, ["event_type"])
    return t.events.join(cut, "event_type").select("event_id", (F.col("value") >= F.col("cutoff")).alias("above"))


@q("fil_09_candidates", "SELECT inchikey_connectivity, n_plants FROM compounds_unique WHERE stereo_resolved AND n_plants >= 3 AND heavy_atom_count BETWEEN 15 AND 45")
def fil_09(t):
    return t.compounds_unique.filter("stereo_resolved AND n_plants >= 3 AND heavy_atom_count BETWEEN 15 AND 45").select("inchikey_connectivity", "n_plants")


@q("fil_10_min_support", "WITH p AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT k, count(*) AS n_suppliers, sum(n)::BIGINT AS n_links FROM p, (VALUES (1), (3), (5)) v(k) WHERE n >= k GROUP BY k")
def fil_10(t):
    n = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))
    return n.select("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).filter("n >= k").groupBy("k").agg(F.count(F.lit(1)).alias("n_suppliers"), F.sum("n").alias("n_links"))


@q("fil_12_detail_urls", r"SELECT plant_index, source_page_url FROM plant_index WHERE regexp_matches(source_page_url, '^https?://') AND NOT regexp_matches(lower(source_page_url), '/(login|register|search|about|contact)') AND list_has_any(string_split_regex(regexp_extract(lower(source_page_url), '^https?://[^/]+([^?#]*)', 1), '[/_-]+'), ['plant','plants','compound','compounds','species','detail','details'])")
def fil_12(t):
    from ..sources.web import detail_url

    return t.plant_index.filter(detail_url(F.col("source_page_url"))).select("plant_index", "source_page_url")


@q("fil_13_encoding_loss", "SELECT plant_index, (contains(scientific_name, '?') OR contains(scientific_name, chr(65533)) OR contains(scientific_name, chr(239) || chr(191) || chr(189))) AS lost FROM plant_index WHERE scientific_name IS NOT NULL")
def fil_13(t):
    from ..functions.names import encoding_loss

    return t.plant_index.filter("scientific_name IS NOT NULL").select("plant_index", encoding_loss(F.col("scientific_name")).alias("lost"))


_GENERAL = " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{n}'" for n, p in NONSPECIFIC)


@q("fil_14_nonspecific_name", f"SELECT record_id, CASE {_GENERAL} END AS pattern FROM names")
def fil_14(t):
    return t.names.select("record_id", nonspecific(F.col("name")).alias("pattern"))


@q("agg_32_funnel", f"SELECT step_no, step, n, floor(n * 100.0::DOUBLE / total * 1e6 + 0.5) / 1e6 AS pct FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {USABLE}) AS u, count(*) FILTER (WHERE {STRICT}) AS s FROM activities), LATERAL (VALUES (0, 'input', total), (1, 'usable', u), (2, 'strict', s)) v(step_no, step, n)")
def agg_32(t):
    f = labels.funnel(t.activities, [("usable", labels.usable()), ("strict", labels.strict())])
    return f.select("step_no", "step", "n", flat(F.col("pct_of_input"), 6).alias("pct"))


@q("agg_37_completeness", r"SELECT sum(CASE WHEN s AND f THEN 1 ELSE 0 END)::BIGINT AS n_both, sum(CASE WHEN s AND NOT f THEN 1 ELSE 0 END)::BIGINT AS n_synonym, sum(CASE WHEN f AND NOT s THEN 1 ELSE 0 END)::BIGINT AS n_family, sum(CASE WHEN NOT f AND NOT s THEN 1 ELSE 0 END)::BIGINT AS n_neither FROM (SELECT regexp_matches(coalesce(synonym, ''), '[\p{L}\p{N}]') AS s, regexp_matches(coalesce(family, ''), '[\p{L}\p{N}]') AS f FROM plant_index)")
def agg_37(t):
    s, f = filled(F.col("synonym")), filled(F.col("family"))
    return t.plant_index.agg(n_if(s & f).alias("n_both"), n_if(s & ~f).alias("n_synonym"), n_if(f & ~s).alias("n_family"), n_if(~f & ~s).alias("n_neither"))


QUERIES, SQL = plan.queries, plan.sql
