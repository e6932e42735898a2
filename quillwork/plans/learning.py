"""Model selection and projections (ML-01, 02, 04, 05, 07, 10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as op
from .registry import Plan, hash_sql

plan = Plan()
q = plan.add


#: Members of a vector, each a feature.
WIDTH = 64
FEATURES = [f"x{i}" for i in range(WIDTH)]
#: The surveyed grid; trees grow as deep as Spark lets them.
GRID = [{"numTrees": n, "featureSubsetStrategy": m, "maxDepth": 30} for n in (300, 600) for m in ("sqrt", "0.1")]


def _rows(t):
    return t.embeddings.select("vec_id", "embedding", (F.col("label") % 2).alias("y"), "label", (F.element_at("embedding", 10) > 0).alias("held"), *(F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(FEATURES)))


@q("ml_01_forest_grouped_cv")
def ml_01(t):
    # the table has no scaffolds, so hashes stand for groups
    rows = _rows(t).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(40)))
    return op.forest_cv(rows, FEATURES, "y", "grp", GRID)


@q("ml_02_group_folds", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_pos, 1 AS n_folds FROM lineitem GROUP BY 1")
def ml_02(t):
    """Every group whole in one of five folds; that the folds have like class counts is tested on its own."""
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return op.group_folds(rows, "l_suppkey", "y").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.countDistinct("fold").alias("n_folds"))


@q("ml_02_class_weights", "SELECT l_returnflag, floor((SELECT count(*) FROM lineitem) / (2.0::DOUBLE * count(*)) * 1e6 + 0.5) / 1e6 AS weight FROM lineitem GROUP BY 1")
def ml_02w(t):
    from ..functions.columns import flat

    w = op.class_weights(t.lineitem.select("l_returnflag"), "l_returnflag")
    return w.groupBy("l_returnflag").agg(flat(F.max("weight"), 6).alias("weight"))


@q("ml_07_principal_components")
def ml_07(t):
    return op.principal_components(t.embeddings, "embedding", 2, ("vec_id", "label"))


@q("ml_10_structure_flags", "SELECT inchikey_connectivity, heavy_atom_count < 6 AS too_small, heavy_atom_count > 70 AS too_large, contains(smiles_flat, '.') AS is_mixture FROM compounds_unique WHERE heavy_atom_count IS NOT NULL AND smiles_flat IS NOT NULL")
def ml_10(t):
    c = t.compounds_unique.filter("heavy_atom_count IS NOT NULL AND smiles_flat IS NOT NULL")
    return c.select("inchikey_connectivity", (F.col("heavy_atom_count") < 6).alias("too_small"), (F.col("heavy_atom_count") > 70).alias("too_large"), F.col("smiles_flat").contains(".").alias("is_mixture"))


@q("ml_04_first_best", f"WITH p AS (SELECT l_linenumber AS point, floor(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) * 50 + 0.5) / 50 AS score FROM lineitem GROUP BY 1) SELECT point, score, point = (SELECT min(point) FROM p WHERE score = (SELECT max(score) FROM p)) AS chosen FROM p")
def ml_04(t):
    """Of points with equal scores the first is chosen; the scores are rounded to fiftieths, so that there are ties."""
    from ..functions.columns import flat

    p = t.lineitem.groupBy(F.col("l_linenumber").alias("point")).agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("s"))
    return op.first_best(p.select("point", (F.floor(F.col("s") * 50 + 0.5) / 50).alias("score")), "point", "score")


@q("ml_05_frozen_before_scoring", hash_sql("(SELECT * FROM embeddings WHERE NOT embedding[10] > 0)", "vec_id || ':' || label", ", true AS frozen, (SELECT count(*) FROM embeddings WHERE embedding[10] > 0) AS n_test, 0::BIGINT AS n_both"))
def ml_05(t):
    """The training rows are hashed, written and hashed again before a test row is read; no test row is among them."""
    from ..operators.joins import overlap_counts
    from ..operators.quality import double_run
    from ..session import materialize

    held = F.element_at("embedding", 10) > 0
    line = F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"))
    train, test = t.embeddings.filter(~held), t.embeddings.filter(held)
    runs = iter((train, materialize(train.select("vec_id", "label").repartition("label"), "frozen")))
    gate = double_run(lambda: next(runs), line).withColumnRenamed("same", "frozen")
    return gate.crossJoin(test.agg(F.count(F.lit(1)).alias("n_test"))).crossJoin(overlap_counts(train, test, "vec_id").select("n_both"))  # one line each


@q("ml_06_score_all_rows")
def ml_06(t):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..operators.similarity import nearest, sign_bits
    from ..session import materialize

    # every row comes out: without a whole vector the probability is NULL, without a vector the similarity too
    rows = _rows(t)
    whole = VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="skip").transform(rows)
    train = materialize(op.class_weights(whole.filter("NOT held AND y IS NOT NULL").select("_x", F.col("y").cast("double").alias("y")), "y"), "train")
    train = train.repartition(t.spark.sparkContext.defaultParallelism).persist()  # a fit of deep trees reads it often
    model = RandomForestClassifier(featuresCol="_x", labelCol="y", weightCol="weight", seed=42, cacheNodeIds=True, **GRID[0]).fit(train)
    train.unpersist()
    scored = model.transform(whole).select("vec_id", vector_to_array("probability")[1].alias("probability"))
    bits = rows.select("vec_id", "held", sign_bits(F.col("embedding")).alias("bits"))
    near = nearest(bits, bits.filter("NOT held"), WIDTH, key="vec_id").select("vec_id", "nearest", "similarity")
    return rows.select("vec_id", "y").join(scored, "vec_id", "left").join(near, "vec_id", "left")


QUERIES, SQL = plan.queries, plan.sql
