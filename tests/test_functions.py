import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import names, numerics, smiles, text
from quillwork.operators import similarity


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_published_statistics():
    assert numerics.chi2_sf(12.246, 3) == pytest.approx(6.5864e-03, rel=1e-3)
    assert numerics.chi2_sf(120.95, 3 + 3) > 0
    assert numerics.chi2_sf(120.95, 5) < 1e-20
    assert numerics.spearman_p(0.204, 71) == pytest.approx(8.793e-02, rel=1e-3)
    assert numerics.spearman_p(-0.219, 71) == pytest.approx(6.652e-02, rel=1e-3)


def test_hypergeometric_by_counting():
    total, marked, drawn = 12, 5, 4
    for k in range(6):
        hits = sum(sum(i < marked for i in s) >= k for s in itertools.combinations(range(total), drawn))
        assert numerics.hypergeom_sf(k, total, marked, drawn) == pytest.approx(hits / math.comb(total, drawn))


def test_holm():
    assert numerics.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


@pytest.mark.parametrize("a,b,same", [("C1CCCCC1CC", "CCCC1CCCCC1", True), ("c1ccccc1O", "C1CCCCC1", True), ("C1CCC2CCCCC2C1", "C1CCCC1C1CCCC1", False), ("C1CCCCC1CCC2CC2", "C1CC1CCC2CCCCC2", True), ("C1CCCCC1CCC2CC2", "C1CC1CC2CCCCC2", False), ("c1cc[nH]c1.[Na+]", "N1CCCC1", True), ("C1CCOC1", "C1CCSC1", False), ("C%12CC%12", "C1CC1", True), ("C1=CC=CC=C1C(=O)O", "c1ccccc1", True)])
def test_skeletons(a, b, same):
    assert (smiles.skeleton_key(a) == smiles.skeleton_key(b)) is same


def test_skeleton_without_rings_or_sense():
    assert smiles.skeleton_key("CCO") is None and smiles.scaffold_key("CCO") == "acyclic"
    for bad in ("", None, "C(", "C1CC", "C)", "--", "1CC1", "?"):
        assert smiles.skeleton_key(bad) is None and smiles.scaffold_key(bad) is None


def _shuffled(s, seed):
    """The same graph written from another atom, side by side with the parser's reading."""
    atoms, near = smiles.parse(s)
    rng = random.Random(seed)
    seen, ring, count = set(), {}, itertools.count(1)
    start = rng.randrange(len(atoms))
    tree, order, back = {i: [] for i in range(len(atoms))}, {}, []

    def walk(i, parent):
        order[i] = len(order)
        seen.add(i)
        nbrs = near[i][:]
        rng.shuffle(nbrs)
        for j in nbrs:
            if j == parent:
                continue
            if j not in seen:
                tree[i].append(j)
                walk(j, i)
            elif order[j] < order[i]:
                back.append((i, j))

    walk(start, -1)
    for i, j in back:
        n = next(count)
        ring.setdefault(i, []).append(n)
        ring.setdefault(j, []).append(n)

    def write(i):
        kids = [write(j) for j in tree[i]]
        label = "".join(f"%{n:02d}" for n in ring.get(i, []))
        return atoms[i] + label + "".join(f"({k})" for k in kids[:-1]) + (kids[-1] if kids else "")

    return write(start)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_skeleton_does_not_depend_on_writing(seed):
    s = "c1(ncc(o1)CSCC2C(CNCC(C2)Cc3oc4ccccc4c3)N)COCSCOCCCCCC"
    assert smiles.skeleton_key(_shuffled(s, seed)) == smiles.skeleton_key(s)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_fingerprints_and_properties_do_not_depend_on_writing(seed):
    s = "c1(ncc(o1)CSCC2C(CNCC(C2)Cc3oc4ccccc4c3)N)COCSCOCCCCCC"
    assert smiles.circular_bits(_shuffled(s, seed)) == smiles.circular_bits(s)
    assert smiles.properties_of(_shuffled(s, seed)) == smiles.properties_of(s)


def test_properties():
    assert smiles.properties_of("C1CCCCC1C(Cl)=O") == (9, 1, 2, 1, 3, 2, 6 / 9)
    assert smiles.properties_of("CC.[Na+]") == (3, 0, 1, 0, 1, 0, 0.0)
    assert smiles.properties_of("C(") is None and smiles.circular_bits(" ") is None
    assert len(smiles.circular_bits("CCO")) <= 9


def test_text(spark):
    assert one(spark, " a   b\t", text.squeeze) == "a b"
    assert one(spark, "É", text.fold) == "é"
    assert one(spark, None, text.name_key) is None
    assert one(spark, " inchikey=abcdefghijklmn-op ", text.connectivity) == "ABCDEFGHIJKLMN"
    assert one(spark, " — ", text.connectivity) is None
    assert [one(spark, v, text.filled) for v in (None, "", " - ", "ক", "7")] == [False, False, False, True, True]


def test_bracket_aware_split(spark):
    f = names.split_outside_brackets
    assert one(spark, "a (b, c), d [e, f], g", f) == ["a (b, c)", "d [e, f]", "g"]
    assert one(spark, ",, a)b , (c", f) == ["a)b", "(c"]
    assert one(spark, None, f) is None and one(spark, "", f) == []


def test_name_edges(spark):
    assert one(spark, "Acacia nilotica (L.) Delile subsp. indica", names.shape_class) == "subspecies"
    assert one(spark, "Mollugo PENTAPHYLLA L. ()", names.shape_class) == "defect"
    assert one(spark, ". PHYLLANTHUS EMBLICA L.", names.binomial) == "PHYLLANTHUS EMBLICA"
    assert one(spark, "Ficus RACEMOSA L.", names.binomial) == "Ficus RACEMOSA"
    assert one(spark, "Plumbaginaceae.", names.family_key) == "plumbaginaceae"
    assert one(spark, "caf�", names.encoding_loss) is True


def test_assignment_by_trying_all():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.random((n, m)).round(2)
        col, total = similarity.assign_least(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert total == pytest.approx(best) and len(set(col)) == n


def test_main_fragment():
    for text, want in (("CCO.Cl", "CCO"), ("Cl.CCO", "CCO"), ("C.N", "C"), ("CC", "CC"), ("", None), (None, None), ("(.C", "C"), ("--", None)):
        assert smiles.main_fragment(text) == want
