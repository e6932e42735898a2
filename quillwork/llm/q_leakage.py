"""Queries on held-out passages in the documents (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import leakage

#: Words in a row that make a leak certain.
RUN = 13


def _pairs(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items that leaked into it, copied or edited."""
    return leakage.report(_pairs(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 13 or more consecutive words of an item's passage."""
    return _pairs(spark, sf_dir).filter(f"longest_run >= {RUN}").select("doc_id", "item_id").distinct()


_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"


def _words(text: str) -> str:
    """SQL for the words of a text: broken words joined, markup, invisible characters, accents and punctuation removed."""
    joined = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}])[-\x{{00AD}}\x{{2010}}][ \t]*\r?\n\s*([\p{{L}}\p{{N}}])', '\1\2', 'g')"
    bare = rf"regexp_replace(regexp_replace({joined}, '</?[A-Za-z!][^<>]*>', '', 'g'), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{206F}}\x{{FEFF}}]', '', 'g')"
    plain = rf"regexp_replace(strip_accents(lower({bare})), '[^\p{{L}}\p{{N}}\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]', '', 'g')"
    return f"list_filter(string_split_regex({plain}, '{_SPACE}'), lambda x: x <> '')"


_GRAMS = "SELECT {id}, array_to_string(list_slice(w, i, i + {n}), ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - {n} + 1)) AS i FROM {t})"
_FOUND = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_words("passage")} AS w FROM eval_items),
dg AS ({_GRAMS.format(id="doc_id", n=RUN - 1, t="d")}), eg AS ({_GRAMS.format(id="item_id", n=RUN - 1, t="e")})
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

QUERIES = {"p6_leaks": p6_leaks, "p6_found": p6_found}
SQL = {"p6_found": _FOUND}
