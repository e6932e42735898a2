"""Best representative of each group of structure rows, and the record merged from all of them.

Both come from one run of truth discovery. The rows' filled fields are claims of their
sources. Which row survives is one more field of the group: completeness, recency and trust
each claim it for the row that is best by them (the other two, then the smallest molregno,
decide ties), with reliabilities learnt like those of any source. A row that is at least as
complete, recent and trusted as every other is claimed by all three and so has all the
support; where they disagree the learnt reliabilities decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, filled_number, filled_or_null, name_key, strip_ws
from ..session import forget, materialize
from . import compounds, truth
from .components import components

#: The fields that are counted for completeness and voted on.
FIELDS = ("pref_name", "canonical_smiles", "standard_inchi", "standard_inchi_key", "molecular_formula", "molecular_weight")
#: The field that names the surviving row, and who claims it. The mark keeps them apart from names of real sources.
SURVIVOR = "survivor"
CRITERIA = ("completeness", "loaded_at", "trust")
MARK = "\x1f"
#: Reliability the criteria start with.
CRITERIA_PRIOR = 0.8


def grouped(structures: DataFrame, bioactivity: DataFrame, trust: DataFrame) -> DataFrame:
    """The rows of groups of two or more, with their claims and what ranks them.

    Columns: group, molregno, layer, the fields (NULL where not filled), source, loaded_at,
    completeness, trust (0 where the source is missing or unknown).
    """
    keyed = materialize(compounds.keyed(structures, bioactivity), "keyed")
    labels = components(compounds.edges(keyed, rings=False)).select(F.col("node").alias("molregno"), F.col("label").alias("group"))
    source = F.lower(strip_ws(F.col("source_name")))
    ranks = trust.filter("source_name IS NOT NULL").groupBy(source.alias("source")).agg(F.max("trust").alias("trust"))
    complete = sum((F.when(filled_number(F.col(f)) if f == "molecular_weight" else filled(F.col(f)), 1).otherwise(0) for f in FIELDS), F.lit(0))
    value = [F.when(filled_number(F.col(f)), F.col(f).cast("string")) if f == "molecular_weight" else filled_or_null(F.col(f)) for f in FIELDS]
    rows = structures.filter("molregno IS NOT NULL").select("molregno", *(v.alias(f) for v, f in zip(value, FIELDS)), source.alias("source"), "loaded_at", complete.alias("completeness"))
    rows = rows.withColumn("standard_inchi_key", F.regexp_replace(F.upper("standard_inchi_key"), "^INCHIKEY=", ""))
    out = rows.join(labels, "molregno").join(keyed.select("molregno", "layer"), "molregno").join(ranks, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    out = materialize(out, "grouped")
    forget(keyed)
    return out


def _claims(rows: DataFrame) -> DataFrame:
    """Every row's filled fields as claims: ``value`` is what votes are counted by, ``spelled`` how the row writes it.

    Names count without letter case, composition and white space differences, weights to two decimals.
    """
    by = {f: F.col(f) for f in FIELDS} | {"pref_name": F.col("_name_key"), "molecular_weight": F.round(F.col("molecular_weight").cast("double"), 2).cast("string")}
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), by[f].alias("value"), F.col(f).alias("spelled")) for f in FIELDS))).alias("p")
    return rows.withColumn("_name_key", name_key(F.col("pref_name"))).select("group", "source", F.col("loaded_at").alias("at"), pairs).select("group", "source", "at", "p.field", "p.value", "p.spelled").filter("value IS NOT NULL")


def _election(rows: DataFrame) -> DataFrame:
    """What the criteria claim: one line for each group of two or more rows and criterion.

    Maxima of (criterion, other criteria, -molregno), reduced map-side; NULL dates are least.
    """
    ballot = lambda c: F.max(F.struct(c, *(x for x in CRITERIA if x != c), (-F.col("molregno")).alias("m")))
    best = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), *(ballot(c).alias(f"_{c}") for c in CRITERIA)).filter("n_rows > 1")
    votes = F.explode(F.array(*(F.struct(F.lit(MARK + c).alias("source"), F.col(f"_{c}.loaded_at").alias("at"), (-F.col(f"_{c}.m")).cast("string").alias("value")) for c in CRITERIA))).alias("v")
    return best.select("group", votes).select("group", "v.source", "v.at", F.lit(SURVIVOR).alias("field"), "v.value", F.col("v.value").alias("spelled"))


def _prior(trust: DataFrame) -> DataFrame:
    top = trust.agg(F.max("trust")).first()[0] or 1
    known = trust.filter("source_name IS NOT NULL").groupBy(F.lower(strip_ws(F.col("source_name"))).alias("source")).agg((F.max("trust") / F.lit(float(top) * 1.25)).alias("reliability"))
    criteria = trust.sparkSession.createDataFrame([(MARK + c, CRITERIA_PRIOR) for c in CRITERIA], "source string, reliability double")
    return known.unionByName(criteria)


@dataclass
class Elected:
    """What truth discovery finds: the surviving row of each group, and the support of every claim."""

    survivors: DataFrame
    claims: DataFrame
    support: DataFrame
    learnt: DataFrame


def elect(structures: DataFrame, bioactivity: DataFrame, trust: DataFrame) -> Elected:
    """The surviving row of each group of two or more rows: group, n_rows, layer, molregno, agreement, rule.

    Rows are in one group if they share a connectivity layer or a structure text, also
    through other rows. The survivor is the best supported value of the field SURVIVOR, on
    ties the row loaded last; ``agreement`` is its share of the criteria's weight. ``rule`` is
    ``dominant`` where that is all of it, which is so exactly if the row is at least as
    complete, recent and trusted as every other (on a full tie the smallest molregno), else
    ``support``.

    NULL ``loaded_at`` is older than any; NULL sources vote as one source of the lowest prior;
    rows without molregno are left out; empty input gives no lines; extra columns are ignored.
    """
    rows = grouped(structures, bioactivity, trust)
    claims = materialize(_claims(rows).unionByName(_election(rows)), "claims")
    learnt, support = truth.discover(claims, _prior(trust))
    size = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), F.min("layer").alias("layer"))
    won = support.filter((F.col("field") == SURVIVOR) & F.col("wins")).select("group", F.col("value").cast("bigint").alias("molregno"), F.round("support", 9).alias("agreement"))
    survivors = size.join(won, "group").withColumn("rule", F.when(F.col("agreement") >= 1, "dominant").otherwise("support"))
    return Elected(survivors, claims, support, learnt)


def resolve(structures: DataFrame, bioactivity: DataFrame, trust: DataFrame) -> DataFrame:
    """The survivors of ``elect`` with the record merged from all rows of their group.

    The fields hold the values truth discovery supports most, NULL where no row fills them;
    ``least_support`` is the smallest support among them.
    """
    found = elect(structures, bioactivity, trust)
    # A winner comes out as most of its claims spell it, on ties as the latest does.
    backed = found.support.filter((F.col("field") != SURVIVOR) & F.col("wins")).select("group", "field", "value", "support")
    won = found.claims.join(backed, ["group", "field", "value"])
    spelled = won.groupBy("group", "field", "spelled").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.max("support").alias("support"))
    best_spelling = spelled.groupBy("group", "field").agg(F.max(F.struct("n", "at", "spelled")).alias("s"), F.max("support").alias("support"))
    merged = best_spelling.groupBy("group").agg(*(F.max(F.when(F.col("field") == f, F.col("s.spelled"))).alias(f) for f in FIELDS), F.min("support").alias("least_support"))
    return found.survivors.join(merged, "group", "left")


def reliability_table(structures: DataFrame, bioactivity: DataFrame, trust: DataFrame) -> DataFrame:
    """The reliabilities alone, for profiling sources (and the criteria, as ``criterion:`` names)."""
    learnt = elect(structures, bioactivity, trust).learnt
    return learnt.select(F.regexp_replace("source", "^" + MARK, "criterion:").alias("source"), "reliability")
