"""Queries on structure rows: survivors (problem 2) and splits (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import splits, survivors


def _three(spark, d):
    return table(spark, d, "compound_structures"), table(spark, d, "compound_bioactivity_raw"), table(spark, d, "source_trust")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of two or more rows with its surviving row and merged record."""
    return survivors.resolve(*_three(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its size and, where the election is unanimous, its survivor."""
    found = survivors.elect(*_three(spark, sf_dir)).survivors
    return found.select("group", "n_rows", "layer", F.when(F.col("rule") == "dominant", F.col("molregno")).alias("molregno"))


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reliable truth discovery finds each source."""
    return survivors.reliability_table(*_three(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose survivor has all the support: completeness, recency and trust elect the same row."""
    return survivors.elect(*_three(spark, sf_dir)).survivors.filter("rule = 'dominant'").select(F.col("layer").alias("inchikey_connectivity"), "molregno")


def _related(spark, d):
    return splits.related(table(spark, d, "compound_structures"), table(spark, d, "compound_bioactivity_raw"))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh assignment of all molecules, stratified by natural_product."""
    from ..session import materialize

    parts = materialize(_related(spark, sf_dir), "related")
    flag = table(spark, sf_dir, "compound_structures").filter("molregno IS NOT NULL").select("molregno", F.col("natural_product").alias("label"))
    records = materialize(parts.join(flag, "molregno"), "labelled")
    return records.join(splits.assign(records).select("component", "split"), "component").select("molregno", "component", "label", "split")


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of the fresh splits."""
    return p3_split(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("n_components"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of the draft whose related molecules are not all in the same split."""
    return splits.torn(table(spark, sf_dir, "split_draft"), _related(spark, sf_dir)).select("molregno")


_GROUPS = r"""
WITH RECURSIVE base AS (
  SELECT s.molregno, CASE WHEN regexp_matches(coalesce(s.standard_inchi_key, ''), '[\p{L}\p{N}]')
           THEN substring(regexp_replace(upper(regexp_replace(s.standard_inchi_key, '^\s+|\s+$', '', 'g')), '^INCHIKEY=', ''), 1, 14) ELSE b.layer END AS layer,
         CASE WHEN regexp_matches(coalesce(s.canonical_smiles, ''), '[\p{L}\p{N}]') THEN regexp_replace(s.canonical_smiles, '^\s+|\s+$', '', 'g') END AS smiles
  FROM compound_structures s LEFT JOIN (
    SELECT molregno, min(upper(regexp_replace(inchikey_connectivity, '^\s+|\s+$', '', 'g'))) AS layer FROM compound_bioactivity_raw
    WHERE regexp_matches(inchikey_connectivity, '[\p{L}\p{N}]') GROUP BY 1) b USING (molregno)),
link AS (SELECT molregno, 'L:' || layer AS e FROM base WHERE layer IS NOT NULL UNION ALL SELECT molregno, 'S:' || smiles FROM base WHERE smiles IS NOT NULL),
hop AS (SELECT DISTINCT a.molregno AS x, b.molregno AS y FROM link a JOIN link b USING (e)),
walk AS (SELECT molregno AS x, molregno AS y FROM base UNION SELECT w.x, h.y FROM walk w JOIN hop h ON w.y = h.x),
grp AS (SELECT x AS molregno, min(y) AS g FROM walk GROUP BY x),
"""

_P2 = _GROUPS + r"""
r AS (SELECT g, s.molregno, base.layer, s.loaded_at, coalesce(t.trust, 0) AS trust,
  (CASE WHEN regexp_matches(coalesce(pref_name, ''), '[\p{L}\p{N}]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(coalesce(canonical_smiles, ''), '[\p{L}\p{N}]') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(coalesce(standard_inchi, ''), '[\p{L}\p{N}]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(coalesce(standard_inchi_key, ''), '[\p{L}\p{N}]') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(coalesce(molecular_formula, ''), '[\p{L}\p{N}]') THEN 1 ELSE 0 END) + (CASE WHEN molecular_weight IS NOT NULL AND NOT isnan(molecular_weight) THEN 1 ELSE 0 END) AS c
  FROM grp JOIN compound_structures s USING (molregno) JOIN base USING (molregno)
  LEFT JOIN source_trust t ON t.source_name = lower(regexp_replace(s.source_name, '^\s+|\s+$', '', 'g'))),
m AS (SELECT g, count(*) AS n, max(c) AS c, max(loaded_at) AS l, max(trust) AS t, min(layer) AS layer FROM r GROUP BY g HAVING count(*) > 1)
SELECT m.layer AS inchikey_connectivity, min(r.molregno) AS molregno
FROM m JOIN r ON r.g = m.g AND r.c = m.c AND r.loaded_at = m.l AND r.trust = m.t GROUP BY m.g, m.layer
"""

_P2_GROUPS = _P2[: _P2.index("SELECT m.layer AS")] + r"""
SELECT m.g AS "group", m.n AS n_rows, m.layer, min(r.molregno) AS molregno
FROM m LEFT JOIN r ON r.g = m.g AND r.c = m.c AND r.loaded_at IS NOT DISTINCT FROM m.l AND r.trust = m.t GROUP BY ALL
"""

QUERIES = {"p2_groups": p2_groups, "p2_survivors": p2_survivors, "p2_reliability": p2_reliability, "p2_found": p2_found, "p3_split": p3_split, "p3_profile": p3_profile, "p3_found": p3_found}
SQL = {"p2_groups": _P2_GROUPS, "p2_found": _P2}
