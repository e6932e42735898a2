"""Names of plants and compounds: cleaning, classes, review flags."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import nfc, squeeze

#: General terms that are no single compound, the first that matches counts.
NONSPECIFIC = (
    ("oil", r"(?i)^(essential\s+)?oils?$"),
    ("essential oil", r"(?i)\bessential\s+oils?\b"),
    ("extract", r"(?i)\bextracts?\b"),
    ("unknown", r"(?i)\bunknown\b"),
    ("unidentified", r"(?i)\bunidentified\b"),
    ("fatty acid", r"(?i)\bfatty\s+acids?\b"),
    ("fraction", r"(?i)\bfractions?\b"),
    ("crude", r"(?i)\bcrude\b"),
    ("class", r"(?i)^(total\s+)?(alkaloids|flavonoids|saponins|tannins|phenolics|terpenoids|glycosides)$"),
    ("resin", r"(?i)^(resin|gum|wax)$"),
    ("oleoresin", r"(?i)\boleoresin\b"),
)
#: Structural classes of names that found no match, the first that matches counts.
UNMATCHED = (
    ("stereo prefix", r"^\([^)]+\)-"),
    ("inverted", r", "),
    ("bracketed synonym", r"\([A-Za-z0-9\s\-]{2,}\)|\[.+\]"),
    ("class or plural", r"(?i)s$|derivatives|fraction|extract|glycosides|alkaloids|phenols|flavonoids|tannins|saponins"),
)
#: Words of a compound name that tell isomers apart and not compounds, and words that say little.
STEREO_WORDS = ("alpha", "beta", "gamma", "delta", "epsilon", "omega", "cis", "trans", "meso", "allo", "neo", "iso", "sec", "tert", "e", "z", "r", "s", "d", "l", "dl")
LIGHT_WORDS = ("alpha", "beta", "gamma", "delta", "cis", "trans", "allo", "meso", "neo", "sec", "tert", "iso", "acid", "ester")
#: Words that join the authors of a scientific name, and authors whose son is cited as "f.".
AUTHOR_LINKS = ("ex", "ex.", "&", "et", "sensu", "non")
FATHERS = ("hook.", "burm.", "l.", "forst.", "schult.", "hallier")
#: Least ratio of matching blocks at which two stems are spellings of one name.
SAME_STEM = 0.82


def first_match(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern of a table that the text matches, else NULL."""
    return F.coalesce(*(F.when(c.rlike(pattern), F.lit(label)) for label, pattern in table))


def encoding_loss(c: Column) -> Column:
    """A question mark, the replacement character, or its three bytes read as Latin-1."""
    return c.contains("?") | c.contains("�") | c.contains("ï¿½")


def nonspecific(c: Column) -> Column:
    """The general term a name is or holds, else NULL."""
    return first_match(c, NONSPECIFIC)


def clean(c: Column) -> Column:
    """Straight quotes, single spaces; locants and stereo marks stay."""
    return squeeze(F.translate(c, " ‘’“”`´", " ''\"\"''"))


def species_key(c: Column) -> Column:
    """Comparison key of a scientific name: composed, single spaces, lower case."""
    return F.lower(squeeze(nfc(F.coalesce(c, F.lit("")))))


def family_key(c: Column) -> Column:
    """Comparison key of a family name: as ``species_key`` without trailing dots."""
    return F.regexp_replace(species_key(c), r"\.+$", "")


def change_class(raw: Column, key: Column) -> Column:
    """What separates a raw name from its key: nothing, case, white space, trailing dots, both, or more."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    joined = squeeze(bare)
    dotless = lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")
    return (
        F.when(bare == key, "none")
        .when(F.lower(bare) == key, "case")
        .when(joined == key, "white space")
        .when((dotless(bare) == key) | (dotless(joined) == key), "punctuation")
        .when(F.lower(joined) == key, "white space and case")
        .otherwise("other")
    )


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def name_parts(c: Column) -> dict[str, Column]:
    """What a scientific name is made of: words, words before a bracket, rank, bracket pair, joined authors."""
    words = _words(c)
    marks = F.split(F.lower(c), r"(?U)\W+")
    n = F.size(words)
    inner = F.slice(words, 2, F.greatest(n - 2, F.lit(0)))
    # a father and then "f.", both as the ends and starts of words
    sons = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(words, i + 1), F.lit("")).startswith("f.") & F.lower(F.coalesce(F.try_element_at(words, i), F.lit(""))).rlike(r"(^|\W)(" + "|".join(f.replace(".", r"\.") for f in FATHERS) + r")$"))
    return {
        "words": words,
        "n": n,
        "before": _words(F.substring_index(c, "(", 1)),
        "rank": F.when(F.array_contains(marks, "subsp"), "subsp.").when(F.array_contains(marks, "var"), "var."),
        "bracketed": c.contains("(") & c.contains(")"),
        "joined": F.arrays_overlap(inner, F.array(*map(F.lit, AUTHOR_LINKS))) | sons,
    }


def _pair(words: Column) -> Column:
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))


def shape_class(c: Column) -> Column:
    """What a scientific name consists of: infraspecific rank, bracketed author, several authors, one, none; or a defect."""
    p = name_parts(c)
    starts_bare = ~F.coalesce(F.try_element_at(p["words"], F.lit(1)), F.lit(".")).startswith(".")
    sound = starts_bare & ~c.rlike(r"\(\s*\)")
    authors = F.when(p["bracketed"], F.when(F.size(p["before"]) == 2, "parenthetical author")).when((p["joined"] | (p["n"] > 3)) & (p["n"] >= 2), "several authors").when(p["n"] == 3, "one author").when(p["n"] == 2, "no author")
    ranked = F.when(p["rank"] == "subsp.", "subspecies").when(p["rank"] == "var.", "variety")
    return F.when(c.isNotNull(), F.coalesce(ranked, F.when(sound, authors), F.lit("defect")))


def binomial(c: Column) -> Column:
    """The first two words of a name, without what a bracket opens; NULL with fewer than two."""
    return _pair(_words(F.substring_index(F.regexp_replace(c, r"(?U)^[.\s]+", ""), "(", 1)))


def query_name(c: Column) -> Column:
    """``pattern`` and ``query`` of a scientific name, by the first of these that yields a name to ask for.

    A subspecies or variety keeps its rank and epithet (a variety only the first two words
    before it), a bracketed author leaves the two words before the bracket, several authors or
    one leave the first two words. Anything else is for ``review`` and asked for as it is.
    """
    p = name_parts(c)
    cut = lambda rank: F.split(F.trim(c), rf"(?i)\s*\b{rank}\b\.?\s*", 2)
    epithet = lambda rank: F.nullif(F.regexp_extract(F.try_element_at(cut(rank), F.lit(2)), r"^([A-Za-z]+)", 1), F.lit(""))
    lead = {"subsp": F.trim(F.substring_index(cut("subsp")[0], "(", 1)), "var": F.coalesce(_pair(_words(cut("var")[0])), cut("var")[0])}
    infra = lambda rank: F.when(F.array_contains(F.split(F.lower(c), r"(?U)\W+"), rank), F.concat(lead[rank], F.lit(f" {rank}. "), epithet(rank)))
    tries = (
        ("subspecies", infra("subsp")),
        ("variety", infra("var")),
        ("parenthetical author", F.when(p["bracketed"] & (F.size(p["before"]) == 2), _pair(p["before"]))),
        ("several authors", F.when(p["joined"] | (p["n"] > 3), _pair(p["words"]))),
        ("one author", F.when(p["n"] == 3, _pair(p["words"]))),
        ("review", F.trim(c)),
    )
    return F.coalesce(*(F.when(q.isNotNull(), F.struct(F.lit(pattern).alias("pattern"), q.alias("query"))) for pattern, q in tries))


def short_query(c: Column) -> Column:
    """``pattern`` and ``query`` by brackets and number of words alone: the small form of ``query_name``."""
    p = name_parts(c)
    by_count = F.when(p["bracketed"], F.struct(F.lit("parenthetical author").alias("pattern"), F.trim(F.substring_index(c, "(", 1)).alias("query")))
    by_count = by_count.when(p["n"] == 3, F.struct(F.lit("one author").alias("pattern"), _pair(p["words"]).alias("query"))).when(p["n"] > 3, F.struct(F.lit("several authors").alias("pattern"), _pair(p["words"]).alias("query")))
    return by_count.when(c.isNotNull(), F.struct(F.lit("other").alias("pattern"), F.trim(c).alias("query")))


def variant_decision(raw: Column, candidate: Column) -> Column:
    """Which of two spellings finds rows: ``raw matched``, ``improved``, ``both empty``; ``needs review`` where a count is missing."""
    return F.when(raw > 0, "raw matched").when((raw == 0) & (candidate > 0), "improved").when((raw == 0) & (candidate == 0), "both empty").otherwise("needs review")


def unmatched_class(c: Column) -> Column:
    """Structural class of a compound name that found no match."""
    return F.when(c.isNotNull(), F.coalesce(first_match(c, UNMATCHED), F.lit("other")))


def stereo_free(c: Column) -> Column:
    """Key of a compound name: its words that are neither stereo words nor locants, as plain letters and digits.

    A locant is a number with at most one letter. Names are composed first, so that the key
    does not depend on composition; signs of rotation and of doubt stand for nothing.
    """
    words = F.split(F.regexp_replace(F.lower(nfc(c)), r"[?\u00b1+]", ""), r"(?U)\W+")
    telling = F.filter(words, lambda w: ~w.isin(*STEREO_WORDS) & ~w.rlike(r"^[0-9]+[a-z]?$"))
    return F.regexp_replace(F.array_join(telling, ""), "[^a-z0-9]", "")


def lead_word(c: Column) -> Column:
    """The first word of three letters or more that is not a LIGHT_WORD; NULL without one."""
    words = F.split(F.lower(c), r"(?U)[\s()\[\]+\u00b1?,/\\0-9-]+")
    return F.try_element_at(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*LIGHT_WORDS)), F.lit(1))


def light_term(c: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    marks = r"""[\s.,;:!?'"–—()\[\]{}-]+"""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), f"^{marks}|{marks}$", "")


def compound_id(c: Column) -> Column:
    """Digits after ``CID:`` anywhere in the text, else NULL."""
    return F.nullif(F.regexp_extract(c, r"(?i)\bCID\s*:\s*(\d+)\b", 1), F.lit(""))


def quality_flags(name: Column, ids: Column) -> Column:
    """Review flags of a name record, joined by semicolons; empty if none."""
    flags = F.array(
        F.when(F.coalesce(F.size(ids), F.lit(0)) < 1, "missing_id"),
        F.when(name.contains("?"), "uncertain_name"),
        F.when(F.length(F.trim(name)) < 4, "very_short_name"),
        F.when(name.rlike(r"-\s+"), "spacing_anomaly"),
    )
    return F.array_join(F.array_compact(flags), ";")


def doi(c: Column) -> Column:
    """A DOI in the text without trailing dots, else NULL."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", 0), r"\.+$", ""), F.lit(""))


def url(c: Column) -> Column:
    """The first web address in the text, else NULL."""
    return F.nullif(F.regexp_extract(c, r"https?://\S+", 0), F.lit(""))


#: Brackets that keep commas together.
OPENERS, CLOSERS = "([（【", ")]）】"


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_outside_brackets(s):
    """Parts between commas that no bracket encloses, trimmed, without empty ones; any closer ends any opener."""

    def one(text: str) -> list[str]:
        depth, start, out = 0, 0, []
        for i, ch in enumerate(text):
            if ch in OPENERS:
                depth += 1
            elif ch in CLOSERS:
                depth = max(0, depth - 1)
            elif ch == "," and not depth:
                out.append(text[start:i])
                start = i + 1
        out.append(text[start:])
        return [p for p in (x.strip() for x in out) if p]

    return s.map(one, na_action="ignore")


def link_tiers(links: DataFrame, known: DataFrame, layers: DataFrame, found: DataFrame) -> DataFrame:
    """``layer``, ``name``, ``tier`` and ``reason`` of links between names (key ``k``) and layers.

    ``known``: distinct (k, layer) of synonyms; ``layers``: k with its least and greatest
    layer; ``found``: k with the number of records a look-up gives. The first reason that
    holds counts: a synonym of that layer; no record; records whose one layer is, or whose
    layers are not, the link's; one record or several of unknown layer.
    """
    synonym = known.select("k", "layer", F.lit(True).alias("_synonym"))
    j = links.join(synonym, ["k", "layer"], "left").join(layers, "k", "left").join(found, "k", "left")
    one_layer = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("layer"))
    reason = (
        F.when(F.col("_synonym"), "synonym match")
        .when(F.coalesce("n", F.lit(0)) == 0, "name not found")
        .when(one_layer, "same connectivity")
        .when(F.col("lo").isNotNull(), "other connectivity")
        .when(F.col("n") == 1, "one record")
        .otherwise("several records")
    )
    tier = F.when(F.col("reason").isin("synonym match", "same connectivity", "one record"), "high").when(F.col("reason") == "other connectivity", "low").otherwise("medium")
    return j.select("layer", "name", reason.alias("reason")).select("layer", "name", tier.alias("tier"), "reason")


def phrase_contexts(rows: DataFrame, text: str, phrases: tuple[str, ...], reach: int = 40) -> DataFrame:
    """One line for each place where a phrase stands: ``phrase``, ``before`` and ``after`` (up to ``reach`` characters) in place of the text.

    Only texts that hold some phrase go through Python, once for all phrases.
    """
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("phrase", "before", "after")]))

    @F.pandas_udf(kind)
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [(p, x[max(0, m.start() - reach) : m.start()], x[m.end() : m.end() + reach]) for p in phrases for m in re.finditer(re.escape(p), x)])

    keep = [c for c in rows.columns if c != text]
    some = reduce(lambda a, b: a | b, (F.col(text).contains(p) for p in phrases))
    return rows.filter(some).select(*keep, F.explode(find(text)).alias("m")).select(*keep, "m.*")


@F.pandas_udf(T.BooleanType())
def all_alike(a, b):
    """True if every stem of the first array and every stem of the second match in SAME_STEM of their letters or more."""
    from difflib import SequenceMatcher

    def alike(x: str, y: str) -> bool:
        x, y = min(x, y), max(x, y)
        return x == y or 2 * min(len(x), len(y)) >= SAME_STEM * (len(x) + len(y)) and SequenceMatcher(None, x, y).ratio() >= SAME_STEM

    return pd.Series([all(alike(x, y) for x in xs for y in ys) for xs, ys in zip(a, b)], dtype="boolean")
