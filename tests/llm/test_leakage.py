import numpy as np
import pytest

from quillwork.llm import leakage as lk

ITEM = "The quick brown fox jumps over the lazy dog while seven bright stars watch a quiet river bend beneath old stone walls"
SCHEMA = "doc_id bigint, text string, item_id string"


def pairs(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)
    q = spark.createDataFrame([(i, p) for i, p in items], "item_id bigint, passage string")
    return {(r.doc_id, r.item_id): r for r in lk.leaks(d, q, **kw).collect()}


def test_words():
    w = lk.words
    assert w("Café naïve <b>bold</b> **x** A-B­​ c — '") == ["cafe", "naive", "bold", "x", "ab", "c"]
    assert w("hy-\nphen and soft­\r\n  ly, - item\n- next") == ["hyphen", "and", "softly", "item", "next"]
    assert w("see [here](https://x.example/y) &amp; C(=O)[N+](=O)[O-]") == ["see", "here", "conoo"]
    assert w("Γειά 中文") == ["γεια", "中文"]
    assert w(None) == w("") == w(" \n\t -- ") == []


def test_whole_part_edited_and_none(spark):
    w = ITEM.split()
    edited = w[:]
    for i in (8, 17):
        edited[i] = "changed"
    docs = [(1, "noise " * 30 + ITEM.upper() + " noise" * 30), (2, " ".join(w[3:16])), (3, " ".join(w[3:15])), (4, "x " + " ".join(edited)), (5, None), (6, ""), (7, "nothing of it at all here " * 20), (1, ITEM)]
    got = pairs(spark, docs, [(10, ITEM), (11, None), (12, "too short item"), (None, ITEM), (13, "")])
    assert got[1, 10].longest_run == len(w) and got[1, 10].similarity == 1
    assert got[2, 10].longest_run == 13 and got[3, 10].longest_run == 12
    assert got[4, 10].longest_run < 13 and got[4, 10].score >= 30
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 10)}


def test_every_run_of_window_words_is_found(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(40)]  # few words, so n-grams are common
    items = [(i, " ".join(rng.choice(vocab, 40))) for i in range(20)]
    docs = []
    for d in range(150):
        text = list(rng.choice(vocab, 60))
        src = items[d % 20][1].split()
        n, a = int(rng.integers(9, 25)), int(rng.integers(0, 15))
        text[10:10] = src[a : a + n]
        docs.append((d, " ".join(text)))
    docs += [(1000 + i, docs[0][1]) for i in range(75)]  # a third are copies
    got = pairs(spark, docs, items, least_score=0)
    for d, text in docs:
        t = text.split()
        grams = {n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for n in range(9, 41)}
        for i, p in items:
            s = p.split()
            longest = max((n for n in range(9, 41) if any(tuple(s[a : a + n]) in grams[n] for a in range(len(s) - n + 1))), default=0)
            if longest:
                assert got[d, i].longest_run == longest


def test_blocks_and_long_texts(spark, monkeypatch):
    items = [(i, f"item{i} " + ITEM.replace("fox", f"fox{i}")) for i in range(6)]
    filler = "some other words that say nothing " * 4000
    docs = [(i, filler + items[i][1] + " " + filler) for i in range(3)]
    one = pairs(spark, docs, items)
    monkeypatch.setattr(lk, "BLOCK_WORDS", 30)
    monkeypatch.setattr(lk, "PIECE", 64)
    many = pairs(spark, docs, items)
    assert one.keys() == many.keys() and all(one[k].score == many[k].score and one[k].longest_run == many[k].longest_run for k in one)


def plain_alignment(a, b):
    h = np.zeros((len(b) + 1, len(a) + 1), int)
    r = np.zeros_like(h)
    for i, y in enumerate(b, 1):
        for j, x in enumerate(a, 1):
            same = x == y and x != 0
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            r[i, j] = r[i - 1, j - 1] + 1 if same else 0
    return h.max(), r.max()


def test_alignment_by_plain_recursion():
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.int32) for _ in range(60)]
    b = [rng.integers(1, 6, rng.integers(1, 25)).astype(np.int32) for _ in range(60)]
    s, n = lk.align(a, b)
    assert [(int(x), int(y)) for x, y in zip(s, n)] == [tuple(map(int, plain_alignment(x, y))) for x, y in zip(a, b)]


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, ITEM)]) == {} and pairs(spark, [(1, ITEM)], []) == {}


def test_found_by_brute_force(spark, sf):
    from quillwork.llm.q_leakage import p6_found
    from quillwork.session import table

    grams = {}
    for r in table(spark, sf, "eval_items").collect():
        w = lk.words(r.passage)
        for a in range(len(w) - 12):
            grams.setdefault(tuple(w[a : a + 13]), set()).add(r.item_id)
    want = set()
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        w = lk.words(r.text)
        for a in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[a : a + 13]), ())}
    assert {tuple(r) for r in p6_found(spark, sf).collect()} == want and want
    assert pytest


def test_recall_of_edited_excerpts(spark, sf):
    """Of excerpts that alignment itself tells, rare seeds find nine in ten, whatever their length and the share of replaced words."""
    import random

    from quillwork.session import table

    rng = random.Random(3)
    passages = [r.passage for r in table(spark, sf, "eval_items").collect() if r.passage]
    docs = [lk.words(r.text) for r in table(spark, sf, "documents").collect()]
    pool = sorted({w for d in docs for w in d})
    block = lk.make_block(list(range(len(passages))), passages)
    code = lambda ws: np.array([block.vocab.get(w, 0) for w in ws], np.int32)

    def grams(ids):
        h = lk.gram_hashes(ids)
        at = np.minimum(np.searchsorted(block.grams, h), len(block.grams) - 1)
        return at[block.grams[at] == h]

    frequency = np.zeros(len(block.grams), np.int64)
    for d in docs:
        frequency[np.unique(grams(code(d)))] += 1
    start, items = lk.seeds(block, frequency)
    whole = [lk.words(p) for p in passages]
    for length in (15, 20, 30):
        for share in (0.1, 0.2, 0.3):
            told = found = 0
            while told < 60:
                k = rng.randrange(len(whole))
                if len(whole[k]) < length:
                    continue
                a = rng.randrange(len(whole[k]) - length + 1)
                ids = code([rng.choice(pool) if rng.random() < share else w for w in whole[k][a : a + length]])
                if lk.align([ids], [block.seqs[k]])[0][0] < 20:
                    continue
                told += 1
                found += any(k in items[start[g] : start[g + 1]] for g in grams(ids))
            assert found >= 0.9 * told, (length, share, found)
