"""How demanding the prose of each document is.

Syntax and vocabulary features come from built-in expressions in one pass over the whole
texts. In every language a linear ranker learns their weights from pairs of differently
graded documents, with a logistic loss on the difference of features; isotonic regression
turns its scores into levels.

Grades are the bands of a published readability index (LIX: words per sentence plus the
percentage of words of more than six letters) on a bounded sample of each language. No feature
is the index or counts its long words; the ranker has to find the bands in what it sees.

Isotonic levels never fall as scores rise, so a floor under a document's features gives a
floor under its level (``Model.floor``): selections by features can be read off the levels
without losing a case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..session import materialize

#: Documents the ranker of a language is fitted on, at most: those with the smallest hash of their key.
SAMPLE = 4_000
#: Graded pairs of each sampled document, at most.
PAIRS = 8
#: Shorter documents are levelled but not fitted on.
MIN_WORDS = 50
LANGUAGES = ("en", "fr", "bn")
#: Letters from which a word is long for the features, and for the index that grades.
LONG_LETTERS, LIX_LETTERS = 9, 7
#: Lower bounds of the index's bands easy, medium, difficult and very difficult; below is very easy.
GRADES = (30.0, 40.0, 50.0, 60.0)
FEATURES = ("words_per_sentence", "long_share", "letters_per_short_word", "commas_per_sentence", "clause_kinds", "distinct_root")
#: Words that open a subordinate clause.
CLAUSE_WORDS = ("although", "as", "because", "before", "but", "if", "since", "so", "that", "unless", "until", "when", "where", "whereas", "which", "while", "who")
_SPACES = r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def prose(text: Column) -> Column:
    """The text without lines that start with ``#``, ``-``, ``*``, ``|`` or ``>``; all white space is ASCII."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[#\-*|>].*$", ""), _SPACES, " ")


def language(lang: Column) -> Column:
    """en, fr, bn or other, by the first two letters; case and outer white space aside."""
    head = F.substring(F.lower(strip_ws(lang)), 1, 2)
    return F.when(head.isin(*LANGUAGES), head).otherwise("other")


def features(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``language``, counts of words, long words and sentences, the FEATURES, and ``lix``, the index that grades.

    A word is a run between white space with a letter, a long one has nine letters or more; a
    sentence ends at ``.``, ``!`` or ``?`` before white space and a capital letter, or at the
    end. Without words all FEATURES are NULL; NULL text has no words.
    """
    p, letters, words = F.col("prose"), F.col("letters"), F.col("words")
    d = documents.select(F.col(key), language(F.col("lang")).alias("language"), F.coalesce(prose(F.col("text")), F.lit("")).alias("prose"))
    # Letters and white space are all that words are counted and measured by; each pass over the text is made once.
    d = d.select(key, "language", "prose", F.lower(F.regexp_replace(p, r"[^\p{L}\s]++", "")).alias("letters"))
    d = d.select(key, "language", "prose", "letters", F.array_remove(F.split(letters, r"\s+"), "").alias("words"))
    d = d.select(
        key,
        "language",
        F.size(words).alias("n_words"),
        F.regexp_count(letters, F.lit(r"\S{%d}\S*+" % LONG_LETTERS)).alias("n_long"),
        F.regexp_count(letters, F.lit(r"\S{%d}\S*+" % LIX_LETTERS)).alias("n_seven"),
        (F.regexp_count(p, F.lit(r"[.!?](?=\s++\p{Lu})")) + 1).alias("n_sentences"),
        F.length(F.regexp_replace(letters, r"\S{%d}\S*+|\s++" % LONG_LETTERS, "")).alias("n_short_letters"),
        (F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))).alias("n_commas"),
        F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in CLAUSE_WORDS)))).alias("n_kinds"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
    )
    w, s = F.nullif(F.col("n_words"), F.lit(0)), F.col("n_sentences")
    some = F.col("n_words") > 0
    return d.select(
        key,
        "language",
        "n_words",
        "n_long",
        F.when(some, s).otherwise(0).alias("n_sentences"),
        (w / s).alias("words_per_sentence"),
        (F.col("n_long") / w).alias("long_share"),
        # apart from the long words, so that no feature says again what another does
        F.when(some, F.coalesce(F.col("n_short_letters") / F.nullif(w - F.col("n_long"), F.lit(0)), F.lit(0.0))).alias("letters_per_short_word"),
        F.when(some, F.col("n_commas") / s).alias("commas_per_sentence"),
        F.when(some, F.col("n_kinds").cast("double")).alias("clause_kinds"),
        (F.col("n_distinct") / F.sqrt(w)).alias("distinct_root"),
        (w / s + 100 * F.col("n_seven") / w).alias("lix"),
    )


def grade_of(lix: np.ndarray) -> np.ndarray:
    """Grades 0 to 4: the band of the index."""
    return np.searchsorted(np.array(GRADES), lix, side="right").astype(float)


def fit_ranker(z: np.ndarray, grade: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a linear score that puts the higher graded of two documents first.

    Every document is paired with those PAIRS fixed steps away in the sample; pairs of one
    grade say nothing. Without any graded pair
    sentence length and long words weigh alike.
    """
    n, d = z.shape
    fallback = np.r_[1.0, 1.0, np.zeros(d - 2)]
    steps = [s for s in sorted({1 + (i * max(1, n // (PAIRS + 1))) for i in range(PAIRS)}) if s < n]
    if not steps:
        return fallback
    i = np.tile(np.arange(n), len(steps))
    j = np.concatenate([(np.arange(n) + s) % n for s in steps])
    up = grade[i] > grade[j]
    down = grade[i] < grade[j]
    diff = np.vstack([z[i[up]] - z[j[up]], z[j[down]] - z[i[down]]])
    if not len(diff):
        return fallback
    w = np.zeros(d)
    for _ in range(rounds):  # Newton steps; the ridge keeps separable samples finite
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = diff.T @ p / len(diff) - ridge * w
        h = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(d)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[list[float], list[float]]:
    """Ascending edges and the level from each edge on: the monotone step function nearest to the grades."""
    at, where = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # [sum, n, first score]
    for s, total, n in zip(at, np.bincount(where, grade), np.bincount(where)):
        blocks.append([float(total), float(n), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2]]
    return [b[2] for b in blocks], [b[0] / b[1] for b in blocks]


@dataclass
class Model:
    """What one language's documents taught: spreads, weights, and the levels from each score on."""

    mean: np.ndarray
    std: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray
    edges: list[float]
    level: list[float]

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, ((F.col(f) - F.lit(float(m))) * F.lit(float(w / s)) for f, m, s, w in zip(FEATURES, self.mean, self.std, self.weight)))

    def of(self, score: Column) -> Column:
        if len(self.edges) == 1:
            return F.lit(float(self.level[0]))
        steps = F.array(*(F.lit(float(e)) for e in self.edges[1:]))
        return F.element_at(F.array(*(F.lit(float(v)) for v in self.level)), F.size(F.filter(steps, lambda e: e <= score)) + 1)

    def floor(self, least: dict[str, float]) -> float:
        """A level that no document of MIN_WORDS words or more whose features are at least ``least`` falls below.

        The other features are somewhere between the smallest and the greatest value that such
        a document of the language has; each is taken where its weight makes the score least.
        """
        low = np.array([max(lo, least.get(f, -np.inf)) for f, lo in zip(FEATURES, self.low)])
        worst = np.where(self.weight >= 0, low, np.maximum(self.high, low))
        terms = (worst - self.mean) / self.std * self.weight
        score = terms.sum() - 1e-9 * (1 + np.abs(terms).sum())  # sums are rounded
        return float(self.level[max(0, int(np.searchsorted(self.edges, score, "right")) - 1)])


def learn(table: DataFrame, key: str = "doc_id") -> dict[str, Model]:
    """A model for each language of a table of ``features``.

    Features are measured against their mean and spread over all documents of the language
    with a word. A language without documents of MIN_WORDS words has no model.
    """
    long_enough = F.col("n_words") >= MIN_WORDS
    stats = [F.sum(F.when(long_enough, 1).otherwise(0)).alias("n_graded")]
    for f in FEATURES:
        stats += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.min(F.when(long_enough, F.col(f))).alias(f"lo_{f}"), F.max(F.when(long_enough, F.col(f))).alias(f"hi_{f}")]
    spread = {r["language"]: r for r in table.filter("n_words > 0").groupBy("language").agg(*stats).collect() if r["n_graded"]}  # a line a language
    if not spread:
        return {}
    hashed = table.filter(long_enough).select("language", *FEATURES, "lix", F.xxhash64(key).alias("h"), F.col(key).alias("_key"))
    parts = []
    for lang, r in spread.items():
        # Of all gradable documents the expected few that can be among the SAMPLE smallest hashes reach the sort.
        cut = -(2**63) + int(2**64 * min(1.0, (SAMPLE + 8 * SAMPLE**0.5) / r["n_graded"])) - 1
        parts.append(hashed.filter((F.col("language") == lang) & (F.col("h") <= cut)).orderBy("h", "_key").limit(SAMPLE))
    held: dict[str, list] = {}
    for r in reduce(DataFrame.unionByName, parts).select("language", *FEATURES, "lix").collect():  # SAMPLE lines a language at most
        held.setdefault(r["language"], []).append(r)
    models = {}
    for lang, rows in held.items():
        r = spread[lang]
        column = lambda head: np.array([r[f"{head}_{f}"] for f in FEATURES], float)  # noqa: B023, E731
        x = np.array([[row[f] for f in FEATURES] for row in rows], float)
        mean, std = column("m"), np.where(column("s") > 0, column("s"), 1.0)
        grade = grade_of(np.array([row["lix"] for row in rows], float))
        z = (x - mean) / std
        weight = fit_ranker(z, grade)
        models[lang] = Model(mean, std, column("lo"), column("hi"), weight, *isotonic(z @ weight, grade))
    return models


def apply(table: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Adds ``score`` and ``level`` to a table of ``features``; NULL without words and without a model of the language."""
    score, level = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang, m in models.items():
        score = F.when((F.col("language") == lang) & (F.col("n_words") > 0), m.score()).otherwise(score)
        level = F.when((F.col("language") == lang) & F.col("score").isNotNull(), m.of(F.col("score"))).otherwise(level)
    return table.withColumn("score", score).withColumn("level", level)


def levels(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Features, ``score`` and ``level`` (0 plain to 4 most demanding) of each document.

    Documents without a word have NULL score and level, as have those of a language in which
    no document has MIN_WORDS words. An empty table gives no lines; other columns are ignored.
    """
    return levelled(documents, key)[0]


def levelled(documents: DataFrame, key: str = "doc_id") -> tuple[DataFrame, dict[str, Model]]:
    """As ``levels``, with the models."""
    table = materialize(features(documents, key), "features")
    models = learn(table, key)
    return apply(table, models), models
