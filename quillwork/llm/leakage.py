"""Held-out passages in a corpus: rare n-gram seeds, then Smith-Waterman alignment.

Test items come in blocks of bounded size; each block is met by every document. One pass over
the corpus normalises each text, looks up its 4-grams among the block's and keeps the
documents that have any. Their document frequencies then pick, for every window of WINDOW
words of every item, the rarest 4-gram as its seed. Every copied run of WINDOW words holds
its seed, so seeds lose no such run, however common its words; there is no cap on hits.
Documents that hold a seed are aligned with the seed's items, all pairs of an Arrow batch at
once. Nothing is shuffled but the frequencies of the block's own n-grams. Where the items take
several blocks, texts are normalised once, into word hashes that every block then reads.

Seeds are 4-grams because five words are too many for edited copies: of excerpts of 15 to 30
words in which 10 to 30 percent of the words were replaced, and which alignment itself tells,
the rarest 5-grams find 0.85 to 1.0 and the rarest 4-grams 0.95 to 1.0 (see the tests).
"""

from __future__ import annotations

import html
import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

N = 4
WINDOW = 9
#: Words of the test items of one block.
BLOCK_WORDS = 400_000
#: Words of a document that are aligned at a time; longer reaches are cut into overlapping pieces.
PIECE = 2_048
#: Word pairs of one alignment batch (pairs times piece width).
BATCH_CELLS = 150_000
MATCH, MISMATCH, GAP = 2, -1, -1

_BROKEN = re.compile(r"(?<=\w)[-\u00ad\u2010][ \t]*\r?\n\s*(?=\w)")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_LINK = re.compile(r"\]\((?:https?:|/|#|mailto:)[^)\s]*\)")
_COMBINING = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_MARKS = re.compile(r"[^\w\s]|_")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCT = string.punctuation.encode() + bytes(set(range(32)) - set(b"\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")) + b"\x7f"


def words(text: str | None) -> list[str]:
    """The words of a text without letter case, accents, punctuation, markup and invisible characters.

    A word broken by a hyphen at a line end is one word; what is left empty is no word. NULL has none.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text).casefold()
            return _MARKS.sub("", text).split()
    return text.encode().translate(_LOWER, _PUNCT).decode().split()


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each N consecutive word numbers; equal hashes of different n-grams only cost an alignment."""
    if len(ids) < N:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - N + 1, np.uint64)
    for i in range(N):
        h = (h ^ ids[i : len(ids) - N + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Block:
    """A block of test items as number sequences over their own vocabulary (0: any other word)."""

    item_id: list
    seqs: list[np.ndarray]
    vocab: dict[str, int]
    grams: np.ndarray
    item_grams: list[np.ndarray]

    def coder(self):
        """The block's word numbers for 64-bit word hashes."""
        hashes = np.fromiter((word_hash(w) for w in self.vocab), np.uint64, len(self.vocab))
        order = np.argsort(hashes)
        hashes, numbers = hashes[order], np.fromiter(self.vocab.values(), np.int32, len(self.vocab))[order]

        def code(h: np.ndarray) -> np.ndarray:
            if not len(hashes):
                return np.zeros(len(h), np.int32)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            return np.where(hashes[at] == h, numbers[at], 0).astype(np.int32)

        return code


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def make_block(item_ids: list, passages: list[str | None]) -> Block:
    vocab: dict[str, int] = {}
    seqs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(p)], np.int32) for p in passages]
    hashes = [gram_hashes(s) for s in seqs]
    grams = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return Block(list(item_ids), seqs, vocab, grams, [np.searchsorted(grams, h) for h in hashes])


def seeds(block: Block, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items each n-gram of the block is a seed of, as offsets into one array: the rarest of some window, the first on ties."""
    gram, item = [], []
    for k, g in enumerate(block.item_grams):
        span = min(WINDOW - N + 1, len(g))
        if not span:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(frequency[g], span)
        chosen = np.unique(g[np.arange(len(windows)) + windows.argmin(1)])
        gram.append(chosen)
        item.append(np.full(len(chosen), k, np.int32))
    gram = np.concatenate(gram) if gram else np.zeros(0, np.int64)
    item = np.concatenate(item) if item else np.zeros(0, np.int32)
    order = np.argsort(gram, kind="stable")
    return np.searchsorted(gram[order], np.arange(len(block.grams) + 1)), item[order]


def align(doc: list[np.ndarray], item: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and longest common run of each pair of number sequences, all pairs at once."""
    b, w, m = len(doc), max(map(len, doc)), max(map(len, item))
    kind = np.int16 if MATCH * m + w < 30_000 else np.int32
    d = np.full((b, w), -1, np.int32)
    t = np.full((b, m), -2, np.int32)
    for r, (x, y) in enumerate(zip(doc, item)):
        d[r, : len(x)] = np.where(x == 0, -1, x)
        t[r, : len(y)] = y
    step = np.arange(w, dtype=kind) * kind(-GAP)
    score, run = np.zeros((b, w + 1), kind), np.zeros((b, w + 1), kind)
    best, longest = np.zeros(b, kind), np.zeros(b, kind)
    for i in range(m):
        same = d == t[:, i : i + 1]
        h = np.maximum(score[:, :-1] + np.where(same, kind(MATCH), kind(MISMATCH)), score[:, 1:] + kind(GAP))
        np.maximum(h, 0, out=h)
        h += step
        np.maximum.accumulate(h, axis=1, out=h)
        h -= step
        score[:, 1:] = h
        np.maximum(best, h.max(1), out=best)
        run[:, 1:] = np.where(same, run[:, :-1] + kind(1), kind(0))
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [np.fromiter(map(word_hash, w), np.uint64, len(w)).tobytes() for w in map(words, pdf["text"])]
        yield pdf.drop(columns="text").assign(text=found)


def _scan(shared, key: str, key_type: T.DataType, hashed: bool):
    """Finds the block's n-grams in texts, or, if ``hashed``, in word hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: Block = shared.value
        get, code = block.vocab.get, block.coder() if hashed else None
        for pdf in batches:
            keys, out = pdf[key].tolist(), []
            if hashed:
                seqs = [code(np.frombuffer(x, np.uint64)) for x in pdf["text"]]
            else:
                seqs = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in map(words, pdf["text"])]
            size = np.array([len(s) for s in seqs])
            if not len(size) or size.sum() < N or not len(block.grams):
                continue
            flat = np.concatenate(seqs)
            known = (flat > 0).astype(np.int8)
            full = np.ones(len(flat) - N + 1, np.int8)
            for i in range(N):
                full &= known[i : len(flat) - N + 1 + i]
            starts = np.flatnonzero(full)
            owner = np.repeat(np.arange(len(size)), size)
            starts = starts[owner[starts] == owner[starts + N - 1]]
            h = np.zeros(len(starts), np.uint64)
            for i in range(N):
                h = (h ^ flat[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            at = np.minimum(np.searchsorted(block.grams, h), len(block.grams) - 1)
            hit = block.grams[at] == h
            starts, at = starts[hit], at[hit]
            begin = np.r_[0, np.cumsum(size)]
            cut = np.searchsorted(starts, begin)
            for r in np.flatnonzero(np.diff(cut)):
                s = slice(cut[r], cut[r + 1])
                out.append((keys[r], seqs[r].tobytes(), (starts[s] - begin[r]).astype(np.int32), at[s].astype(np.int32)))
            if out:
                yield pd.DataFrame(out, columns=[key, "words", "pos", "gram"])

    return run, T.StructType([T.StructField(key, key_type), T.StructField("words", T.BinaryType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("gram", T.ArrayType(T.IntegerType()))])


def _pieces(seq: np.ndarray, pos: np.ndarray, length: int) -> list[np.ndarray]:
    """The parts of a document within two item lengths of a seed; overlapping ones are merged, long ones cut with overlap."""
    reach = 2 * length
    out, lo, hi = [], None, None
    for p in np.sort(pos):
        a, b = max(0, int(p) - reach), min(len(seq), int(p) + N + reach)
        if hi is not None and a <= hi:
            hi = max(hi, b)
        else:
            if hi is not None:
                out.append((lo, hi))
            lo, hi = a, b
    out.append((lo, hi))
    width = max(PIECE, 2 * reach)
    return [seq[s : min(s + width, hi)] for lo, hi in out for s in range(lo, max(lo + 1, hi - reach), width - reach)]


def _aligner(shared, key: str, key_type: T.DataType, id_type: T.DataType, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, (start, items) = shared.value
        for pdf in batches:
            jobs = []  # (row, item, piece)
            for r, (w, pos, gram) in enumerate(zip(pdf["words"], pdf["pos"], pdf["gram"])):
                seq = np.frombuffer(w, np.int32)
                near: dict[int, list[int]] = {}
                for p, g in zip(pos, gram):
                    for k in items[start[g] : start[g + 1]].tolist():
                        near.setdefault(k, []).append(p)
                for k, at in near.items():
                    jobs += [(r, k, piece) for piece in _pieces(seq, np.array(at), len(block.seqs[k]))]
            jobs.sort(key=lambda j: len(j[2]))
            found: dict[tuple[int, int], tuple[int, int]] = {}
            a = 0
            while a < len(jobs):
                b = a + 1
                while b < len(jobs) and (b + 1 - a) * len(jobs[b][2]) <= BATCH_CELLS:
                    b += 1
                score, longest = align([j[2] for j in jobs[a:b]], [block.seqs[j[1]] for j in jobs[a:b]])
                for (r, k, _), s, n in zip(jobs[a:b], score.tolist(), longest.tolist()):
                    old = found.get((r, k), (0, 0))
                    found[r, k] = (max(old[0], s), max(old[1], n))
                a = b
            keys = pdf[key].tolist()
            out = [(keys[r], block.item_id[k], n, s, s / (MATCH * len(block.seqs[k]))) for (r, k), (s, n) in found.items() if s >= least]
            if out:
                yield pd.DataFrame(out, columns=[key, "item_id", "longest_run", "score", "similarity"])

    return run, T.StructType([T.StructField(key, key_type), T.StructField("item_id", id_type), T.StructField("longest_run", T.IntegerType()), T.StructField("score", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", least_score: int = 20) -> DataFrame:
    """Pairs of a document and a test item whose passage it holds, wholly or in part, copied or edited.

    ``documents``: ``key`` and ``text``; ``items``: ``item_id`` and ``passage``. Returns key,
    item_id, ``longest_run`` (most consecutive words in common), ``score`` (local alignment,
    2 a matching word, -1 a changed, added or missing one) and ``similarity`` (score as a
    share of what the whole passage would score), for scores of at least ``least_score``
    (20: ten words in a row, or more with a few edits).

    Every common run of nine words is found; an edited copy is found if it keeps some item
    window's rarest 4-gram. Items of fewer than four words cannot be told from chance and
    leak nowhere. Documents with NULL or empty text, and items with NULL passage or id, have
    no pairs; repeated documents come out each on its own; a repeated item id is several
    items. Empty tables give no lines; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.filter("text IS NOT NULL").select(key, "text")
    held = items.filter("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage")
    total = held.agg(F.sum(F.size(F.split("passage", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    held = materialize(held.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    key_type, id_type = docs.schema[key].dataType, held.schema["item_id"].dataType
    if blocks > 1:
        docs = materialize(docs.mapInPandas(_hashes, T.StructType([docs.schema[key], T.StructField("text", T.BinaryType())])), "words")
    out = None
    for b in range(blocks):
        part = held.filter(F.col("block") == b).orderBy("item_id", "passage").collect()  # one block: BLOCK_WORDS words
        block = make_block([r[0] for r in part], [r[1] for r in part])
        scan, schema = _scan(spark.sparkContext.broadcast(block), key, key_type, blocks > 1)
        hits = materialize(docs.mapInPandas(scan, schema), "hits")
        counts = hits.select(F.explode(F.array_distinct("gram")).alias("g")).groupBy("g").count().collect()  # of this block's n-grams
        frequency = np.zeros(len(block.grams), np.int64)
        for g, n in counts:
            frequency[g] = n
        chosen = spark.sparkContext.broadcast((block, seeds(block, frequency)))
        search, found = _aligner(chosen, key, key_type, id_type, least_score)
        pairs = hits.mapInPandas(search, found)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def report(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One line for each document with leaks: its items (sorted), their number, the longest run and best similarity."""
    return pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.countDistinct("item_id").alias("n_items"), F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))
