"""Nearest neighbours, assignments, structures (JOI-17, 18, 20; ML-03, 08, 09, 11, 16, 17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import flat
from ..functions.smiles import circular_fingerprint, graph_counts, largest_fragment, properties, scaffold
from ..functions.text import connectivity, filled
from ..operators import joins, similarity as op
from ..operators.structures import by_text
from .registry import Plan

plan = Plan()
q = plan.add

_BITS = "WITH b AS (SELECT vec_id, label, embedding[10] > 0 AS held, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS s FROM embeddings), p AS (SELECT a.vec_id AS q, r.vec_id AS n, r.label AS y, len(list_intersect(a.s, r.s))::DOUBLE / (len(a.s) + len(r.s) - len(list_intersect(a.s, r.s))) AS sim FROM b a JOIN b r ON {on}), w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS i FROM p)"


def _bits(t):
    width = len(t.embeddings.select("embedding").first()[0])
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", (F.element_at("embedding", 10) > 0).alias("held"), op.sign_bits(F.col("embedding")).alias("bits")), width


@q("joi_17_nn_tanimoto", _BITS.format(on="a.label = 0 AND r.label <> 0") + " SELECT q AS id, n AS nearest, floor(sim * 1e9 + 0.5) / 1e9 AS similarity FROM w WHERE i = 1")
def joi_17(t):
    b, width = _bits(t)
    return op.nearest(b.filter("label = 0"), b.filter("label <> 0"), width).select("id", "nearest", flat(F.col("similarity"), 9).alias("similarity"))


@q("joi_18_loo_nn", _BITS.format(on="a.vec_id <> r.vec_id") + " SELECT q AS id, n AS nearest, floor(sim * 1e9 + 0.5) / 1e9 AS similarity FROM w WHERE i = 1")
def joi_18(t):
    b, width = _bits(t)
    return op.nearest(b, b, width, exclude_self=True).select("id", "nearest", flat(F.col("similarity"), 9).alias("similarity"))


@q("ml_03_one_nn_classifier", _BITS.format(on="a.held AND NOT r.held") + " SELECT q AS id, (y % 2)::DOUBLE AS predicted, floor(sim * 1e9 + 0.5) / 1e9 AS similarity FROM w WHERE i = 1")
def ml_03(t):
    b, width = _bits(t)
    b = b.withColumn("y", F.col("label") % 2)
    return op.nearest(b.filter("held"), b.filter("NOT held"), width, label="y").select("id", F.col("label").alias("predicted"), flat(F.col("similarity"), 9).alias("similarity"))


@q("sta_14_nn_domain_bins", _BITS.format(on="a.label = 0 AND r.label <> 0") + " SELECT CASE WHEN sim >= 0.5 THEN '>=0.5' WHEN sim >= 0.4 THEN '0.4-0.5' WHEN sim >= 0.3 THEN '0.3-0.4' ELSE '<0.3' END AS bin, count(*) AS n FROM w WHERE i = 1 GROUP BY 1")
def nn_bins(t):
    b, width = _bits(t)
    s = F.col("similarity")
    return op.nearest(b.filter("label = 0"), b.filter("label <> 0"), width).groupBy(F.when(s >= 0.5, ">=0.5").when(s >= 0.4, "0.4-0.5").when(s >= 0.3, "0.3-0.4").otherwise("<0.3").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Atoms of a pose: three members of a vector each, all that make up whole atoms.
ATOMS = 21


def _pose():
    return F.transform(F.sequence(F.lit(0), F.lit(ATOMS - 1)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.element_at("embedding", (i * 3 + k).cast("int")).cast("double")))


@q("joi_20_pose_assignment", "WITH p AS (SELECT vec_id, list_transform(range(21), lambda i: [embedding[3 * i + 1]::DOUBLE, embedding[3 * i + 2]::DOUBLE, embedding[3 * i + 3]::DOUBLE]) AS pose FROM embeddings) SELECT vec_id, 0.0::DOUBLE AS reversed_rmsd, floor(sqrt(3 * 0.01 * 0.01::DOUBLE) * 1e6 + 0.5) / 1e6 AS shifted_rmsd FROM p")
def joi_20(t):
    """The same atoms in another order lie at distance 0; moved by less than half the least distance of two atoms, at that move's length."""
    p = t.embeddings.select("vec_id", _pose().alias("pose"))
    moved = F.transform("pose", lambda a: F.transform(a, lambda x: x + 0.01))
    return p.select("vec_id", flat(op.pose_rmsd(F.col("pose"), F.reverse("pose")), 6).alias("reversed_rmsd"), flat(op.pose_rmsd(F.col("pose"), F.shuffle(moved, F.lit(7))), 6).alias("shifted_rmsd"))


@q("ml_08_structure_graph")
def ml_08(t):
    s = t.compound_structures.filter(filled(F.col("canonical_smiles"))).select("molregno", "canonical_smiles")
    return by_text(s, "canonical_smiles", graph_counts, "g").select("molregno", "g.*")


@q("ml_09_scaffold")
def ml_09(t):
    return by_text(t.compound_structures.filter(filled(F.col("canonical_smiles"))).select("molregno", "canonical_smiles"), "canonical_smiles", scaffold, "scaffold").select("molregno", "scaffold")


_L = r"CASE WHEN regexp_matches(coalesce(standard_inchi_key,''), '[\p{L}\p{N}]') THEN substring(regexp_replace(upper(regexp_replace(standard_inchi_key, '^\s+|\s+$', '', 'g')), '^INCHIKEY=', ''), 1, 14) END"


@q("ml_11_candidates_agree", f"SELECT molecular_formula, count(*) AS n, count(DISTINCT {_L}) = 1 AS agree FROM compound_structures WHERE molecular_formula IS NOT NULL GROUP BY 1")
def ml_11(t):
    k = t.compound_structures.filter("molecular_formula IS NOT NULL").select("molecular_formula", connectivity(F.col("standard_inchi_key")).alias("k"))
    return k.groupBy("molecular_formula").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("k") == F.max("k"), F.lit(False)).alias("agree"))


@q("ml_16_contact_classes", "WITH p AS (SELECT vec_id, label, floor(embedding[1]::DOUBLE * 40) AS x, floor(embedding[2]::DOUBLE * 40) AS y, floor(embedding[3]::DOUBLE * 40) AS z FROM embeddings), c AS (SELECT a.vec_id, count(b.vec_id) AS n FROM p a LEFT JOIN p b ON b.label = 1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 16 WHERE a.label = 0 GROUP BY 1) SELECT CASE WHEN n >= 3 THEN 'many' WHEN n >= 1 THEN 'some' ELSE 'none' END AS contacts, count(*) AS n_points FROM c GROUP BY 1")
def ml_16(t):
    xyz = [F.floor(F.element_at("embedding", i + 1).cast("double") * 40).cast("double").alias(c) for i, c in enumerate("xyz")]
    p = t.embeddings.select("vec_id", "label", *xyz)
    a = p.filter("label = 0")
    near = joins.radius_join(a, p.filter("label = 1"), 4.0).groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return a.join(near, "vec_id", "left").groupBy(F.when(n >= 3, "many").when(n >= 1, "some").otherwise("none").alias("contacts")).agg(F.count(F.lit(1)).alias("n_points"))


@q("ml_17_redocking_pass")
def ml_17(t):
    # nine shifted poses of each reference; it passes if the best lies within 2.0
    p = t.embeddings.select("vec_id", "label", _pose().alias("pose"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("model"))
    moved = F.transform("pose", lambda a: F.transform(a, lambda x: x + (F.col("model") + F.col("label") % 4) * 0.4))
    best = p.select("vec_id", "model", op.pose_rmsd(F.col("pose"), moved).alias("rmsd")).groupBy("vec_id").agg(F.min("rmsd").alias("best"), F.max(F.when(F.col("model") == 0, F.col("rmsd"))).alias("top"))
    return best.select("vec_id", flat(F.col("best"), 6).alias("best"), flat(F.col("top"), 6).alias("top"), (F.col("best") <= 2.0).alias("passes"))


def _fingerprints(t):
    from ..session import materialize

    c = t.compounds_unique.filter(filled(F.col("smiles_flat"))).select(F.col("inchikey_connectivity").alias("id"), "n_plants", circular_fingerprint(F.col("smiles_flat")).alias("bits"))
    return materialize(c, "fingerprints")  # written once; both sides of the search read it


@q("ml_12_circular_fingerprint")
def ml_12(t):
    return _fingerprints(t).select("id", F.size("bits").alias("n_bits"), F.array_join(F.transform(F.array_sort("bits"), lambda b: b.cast("string")), ",").alias("bits"))


@q("ml_10_largest_fragment")
def ml_10f(t):
    """The fragment with most atoms of each structure, the first on ties."""
    c = t.compounds_unique.filter(filled(F.col("smiles_flat"))).select("inchikey_connectivity", "smiles_flat")
    return by_text(c, "smiles_flat", largest_fragment, "fragment").select("inchikey_connectivity", "fragment", (F.col("fragment") != F.trim("smiles_flat")).alias("stripped"))


@q("ml_12_structure_neighbours")
def ml_12n(t):
    f = _fingerprints(t)
    return op.nearest(f.filter("n_plants > 1"), f.filter("n_plants = 1"), 2048)


@q("ml_13_structure_properties")
def ml_13(t):
    s = t.compound_structures.filter(filled(F.col("canonical_smiles"))).select("molregno", "canonical_smiles")
    return by_text(s, "canonical_smiles", properties, "p").select("molregno", "p.*")


QUERIES, SQL = plan.queries, plan.sql
