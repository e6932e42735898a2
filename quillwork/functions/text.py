"""String normalisation as column expressions.

Java's plain ``\\s`` is ASCII only; ``(?U)\\s`` also takes no-break and typographic spaces.
Work Spark has no built-in for (Unicode composition) goes through an Arrow UDF that
receives only the values that need it: ASCII text is sent as NULL.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Outer white space removed, inner runs of any white space as one space."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip_ws(c: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """True if the text holds a letter or a digit; NULL, blanks and placeholder marks are not filled."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def filled_number(c: Column) -> Column:
    """True if the number is neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def filled_or_null(c: Column) -> Column:
    """The text without outer white space, or NULL where it is not filled."""
    return F.when(filled(c), strip_ws(c))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()), na_action="ignore")


def _wide(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), c)


def nfc(c: Column) -> Column:
    """Unicode composition (NFC); ASCII values stay in the JVM."""
    return F.coalesce(_nfc(_wide(c)), c)


def fold(c: Column) -> Column:
    """Case folded and composed; ASCII values stay in the JVM."""
    return F.coalesce(_nfc_fold(_wide(c)), F.lower(c))


def name_key(c: Column) -> Column:
    """Comparison key of a name: composition, letter case and white space aside."""
    return squeeze(fold(c))


def connectivity(c: Column) -> Column:
    """The first 14 characters of a structure key, upper case; a leading ``InChIKey=`` and outer white space aside.

    NULL where the field is not filled.
    """
    bare = F.regexp_replace(F.upper(strip_ws(c)), r"^INCHIKEY=(?U)\s*", "")
    return F.when(filled(c) & filled(bare), F.substring(bare, 1, 14))


def layer_key(c: Column) -> Column:
    """A connectivity key without letter case and outer white space; NULL where not filled."""
    return F.when(filled(c), F.upper(strip_ws(c)))
