"""Queries on documents: mixtures (problem 7) and reading levels (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixture, reading

#: Words per sentence and share of long words that demanding documents exceed.
DEMANDING = {"words_per_sentence": 22.0, "long_share": 0.25}


def _mix(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix."""
    return _mix(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    return _mix(spark, sf_dir)[1]


def p7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not depend on the tokenizer: records and capped sources; that no record comes oftener than it may, and that each source has its expected copies up to one."""
    r = p7_report(spark, sf_dir)
    within = F.abs(F.col("n_copies") - F.col("expected_copies") * F.col("n_records")) < 1.001
    return r.select("source", "n_records", "capped", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), within.alias("as_expected"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their target in the rounded mix although all their records are in it as often as they may be."""
    return p7_report(spark, sf_dir).filter("actual_tokens < target_tokens").filter("n_copies = max_repeats * n_records").select("source")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of each document."""
    return reading.levels(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the features of English documents rest on: words, long words, sentences; and whether the document has a level."""
    d = p8_levels(spark, sf_dir).filter("language = 'en'")
    return d.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_long", "n_sentences")), F.col("level").isNotNull().alias("levelled"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by language and whole level."""
    return p8_levels(spark, sf_dir).groupBy("language", F.floor("level").alias("level")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demanding English documents: those at a level such documents cannot fall below, then the exact rule on them."""
    docs, models = reading.levelled(table(spark, sf_dir, "documents"))
    least = models["en"].floor(DEMANDING) if "en" in models else 0.0
    reach = docs.filter((F.col("language") == "en") & (F.col("n_words") >= reading.MIN_WORDS) & (F.col("level") >= least))
    return reach.filter((F.col("n_words") > 22 * F.col("n_sentences")) & (4 * F.col("n_long") > F.col("n_words"))).select("doc_id")


_COUNTS = r"""
WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^[#*|>-][^\n]*$', '', 'g'), '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]', ' ', 'g') AS t
           FROM documents WHERE starts_with(lower(trim(lang)), 'en')),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda x: regexp_matches(x, '\p{L}')) AS ws FROM p),
n AS (SELECT doc_id, len(ws) AS words, len(list_filter(ws, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 9)) AS long,
             len(regexp_extract_all(t, '[.!?]\s+\p{Lu}')) + 1 AS sentences FROM w)
"""
_P8 = _COUNTS + "SELECT doc_id FROM n WHERE words >= 50 AND words > 22 * sentences AND 4 * long > words"
#: NULL texts have no words.
_P8_COUNTS = _COUNTS + "SELECT doc_id, coalesce(words, 0) AS n_words, coalesce(long, 0) AS n_long, CASE WHEN words > 0 THEN sentences ELSE 0 END AS n_sentences, coalesce(words, 0) > 0 AS levelled FROM n"

#: The cases do not depend on the tokenizer; runs between white space stand for tokens.
_P7 = r"""
WITH d AS (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[-_\s]', '_', 'g') AS k, len(regexp_split_to_array(trim(coalesce(text, '')), '\s+')) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT source, regexp_replace(lower(trim(source)), '[-_\s]', '_', 'g') AS k, target_weight AS w, max_repeats AS m FROM mix_targets),
s AS (SELECT t.source, t.w, t.m, coalesce(sum(d.n), 0) AS size, count(d.n) AS n_records FROM t LEFT JOIN d USING (k) GROUP BY ALL)
"""
_CAPPED = "w / (SELECT sum(w) FROM s) * (SELECT sum(size) FROM s) > m * size"

QUERIES = {"p7_caps": p7_caps, "p8_counts": p8_counts, "p7_copies": p7_copies, "p7_report": p7_report, "p7_found": p7_found, "p8_levels": p8_levels, "p8_profile": p8_profile, "p8_found": p8_found}
SQL = {
    "p7_caps": _P7 + f"SELECT source, n_records, {_CAPPED} AS capped, true AS within_cap, true AS as_expected FROM s",
    "p7_found": _P7 + f"SELECT source FROM s WHERE {_CAPPED}",
    "p8_counts": _P8_COUNTS,
    "p8_found": _P8,
}
