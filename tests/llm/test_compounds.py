import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions.smiles import skeleton_key
from quillwork.llm import splits, survivors, truth

T = [dt.datetime(2025, 1, d) for d in range(1, 9)]
STRUCT = "molregno bigint, chembl_id string, pref_name string, canonical_smiles string, standard_inchi string, standard_inchi_key string, molecular_formula string, molecular_weight double, natural_product int, source_name string, loaded_at timestamp_ntz, `group` string"
K1, K2, K3 = ("A" * 14 + "-UHFFFAOYSA-N", "B" * 14 + "-UHFFFAOYSA-N", "C" * 14 + "-UHFFFAOYSA-N")


def frames(spark, rows, raw=(), trust=(("good", 5), ("bad", 1))):
    s = spark.createDataFrame([(*r, "clash") for r in rows], STRUCT)
    return s, spark.createDataFrame(list(raw), "molregno bigint, inchikey_connectivity string"), spark.createDataFrame(list(trust), "source_name string, trust int")


def row(m, name=None, smi=None, inchi=None, key=None, formula=None, mw=None, src=None, at=None):
    return (m, None, name, smi, inchi, key, formula, mw, None, src, at)


def test_survivors(spark):
    rows = [
        # one layer, spelled three ways; 2 dominates
        row(1, "x", "C", "I", " inchikey=" + K1.lower(), None, None, "bad", T[0]),
        row(2, "x", "C", "I", K1, "F", 1.0, " GOOD ", T[1]),
        # joined to the group by the bioactivity rows, and nothing better
        row(3, None, None, None, " - ", None, float("nan"), None, None),
        # a full tie: the smaller survives
        row(11, "a", None, None, K2, None, None, "good", T[2]),
        row(10, "b", None, None, K2, None, None, "good", T[2]),
        # no row dominates: 21 is later, 20 more complete
        row(20, "a", "CC", None, None, "G", None, "bad", T[0]),
        row(21, None, " CC ", None, K3, None, None, "bad", T[3]),
        row(22, "solo"),
        (None, None, "none", "CC", None, K3, None, None, None, None, None),
    ]
    out = {r.molregno: r for r in survivors.resolve(*frames(spark, rows, [(3, " aaaaaaaaaaaaaa\t"), (3, None), (None, "B")])).collect()}
    assert {m: (r.rule, r.layer, r.n_rows) for m, r in out.items() if r.rule == "dominant"} == {2: ("dominant", "A" * 14, 3), 10: ("dominant", "B" * 14, 2)}
    (other,) = [r for r in out.values() if r.rule == "support"]
    assert other.n_rows == 2 and other.molecular_formula == "G" and other.canonical_smiles == "CC"
    assert out[2].pref_name == "x" and out[2].molecular_weight == "1.0"


def test_spellings_vote_together(spark):
    rows = [row(1, "Rutin ", key=K1, src="good", at=T[0]), row(2, "RUTIN", key=K1, src="good", at=T[1]), row(3, "rutin", key=K1, src="good", at=T[2]), row(4, "rutin", key=K1, src="bad", at=T[0]), row(5, "other", key=K1, src="good", at=T[4]), row(6, "other", key=K1, src="good", at=T[4])]
    (r,) = survivors.resolve(*frames(spark, rows)).collect()
    assert r.pref_name == "rutin" and r.molregno == 5 and r.rule == "dominant"


def test_dominance_is_full_agreement(spark):
    """The elected row has all the support exactly where some row is best by all three criteria."""
    rng = np.random.default_rng(5)
    rows, groups = [], {}
    for g in range(120):
        key = "".join(chr(65 + (g // 26**i) % 26) for i in range(14)) + "-UHFFFAOYSA-N"
        for i in range(int(rng.integers(2, 5))):
            m = g * 10 + i
            full, at, src = int(rng.integers(0, 3)), None if rng.random() < 0.1 else T[rng.integers(0, 3)], [None, "good", "bad"][rng.integers(0, 3)]
            rows.append(row(m, name="x" if full > 0 else None, formula="F" if full > 1 else None, key=key, src=src, at=at))
            groups.setdefault(key[:14], []).append((full, at is not None, at or T[0], {"good": 5, "bad": 1}.get(src, 0), -m))
    want = {}
    for layer, xs in groups.items():
        best = [x for x in xs if all(x[0] >= y[0] and x[1:3] >= y[1:3] and x[3] >= y[3] for y in xs)]
        if best:
            want[layer] = -max(x[4] for x in best)
    out = survivors.elect(*frames(spark, rows)).survivors.collect()
    assert {r.layer: r.molregno for r in out if r.rule == "dominant"} == want and 20 < len(want) < 110
    assert len(out) == 120 and all(0 < r.agreement <= 1 for r in out)


def test_no_survivor_without_votes(spark, monkeypatch):
    """The survivors come out of truth discovery: without its votes there are none."""
    real = truth.discover
    monkeypatch.setattr(truth, "discover", lambda claims, prior: real(claims.filter(F.col("field") != survivors.SURVIVOR), prior))
    rows = [row(1, "x", key=K1, src="good", at=T[0]), row(2, "y", key=K1, src="good", at=T[1])]
    assert survivors.elect(*frames(spark, rows)).survivors.count() == 0


def test_survivors_empty(spark):
    assert survivors.resolve(*frames(spark, [])).count() == 0
    assert survivors.resolve(*frames(spark, [row(1), row(2)], trust=())).count() == 0


def _claims(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n):
        for s, p in (("a", 0.95), ("b", 0.9), ("c", 0.3), ("d", 0.3)):
            out.append((g, "f", "true" if rng.random() < p else f"wrong{rng.integers(3)}", s, T[0]))
    return spark.createDataFrame(out, "`group` bigint, field string, value string, source string, at timestamp_ntz"), out


def test_truth_beats_majority(spark):
    claims, raw = _claims(spark)
    prior = spark.createDataFrame([(s, 0.5) for s in "abcd"], "source string, reliability double")
    learnt, support = truth.discover(claims, prior)
    r = {x.source: x.reliability for x in learnt.collect()}
    assert min(r["a"], r["b"]) > max(r["c"], r["d"])
    right = support.filter("wins AND value = 'true'").count()
    majority = 0.0
    for _, g in itertools.groupby(raw, key=lambda x: x[0]):
        values = [x[2] for x in g]
        most = [v for v in set(values) if values.count(v) == max(map(values.count, values))]
        majority += ("true" in most) / len(most)
    assert right > majority and right > 270


def test_unfinished_truth_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(truth, "MAX_ROUNDS", 1)
    claims = spark.createDataFrame([("g", "f", v, s, 1) for v, s in (("x", "a"), ("x", "b"), ("y", "c"))], "group string, field string, value string, source string, at int")
    prior = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.3)], "source string, reliability double")
    with pytest.raises(RuntimeError):
        truth.discover(claims, prior)


def test_truth_matches_plain_rounds(spark):
    claims, raw = _claims(spark, 60, 1)
    prior = {s: 0.6 for s in "abcd"}
    learnt, support = truth.discover(claims, spark.createDataFrame(list(prior.items()), "source string, reliability double"))
    r = dict(prior)
    for _ in range(truth.MAX_ROUNDS):
        tau = {s: -np.log1p(-x) for s, x in r.items()}
        total, votes = {}, {}
        for g, f, v, s, _t in raw:
            total[g] = total.get(g, 0) + tau[s]
            votes[g, v] = votes.get((g, v), 0) + tau[s]
        new = {s: min(0.99, max(0.01, np.mean([votes[g, v] / total[g] for g, _f, v, s2, _t in raw if s2 == s]))) for s in r}
        moved = max(abs(new[s] - r[s]) for s in r)
        r = new
        if moved < truth.TOLERANCE:
            break
    for x in learnt.collect():
        assert x.reliability == pytest.approx(r[x.source], abs=1e-9)


def _brute_components(rows, raw):
    import re

    good = lambda x: bool(x and re.search(r"[^\W_]", x))
    layer = {m: k.strip().upper() for m, k in raw if m is not None and good(k)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for m, smi, key in rows:
        ents = []
        lay = re.sub("^INCHIKEY=", "", key.strip().upper())[:14] if good(key) else layer.get(m)
        if lay:
            ents.append("L" + lay)
        if good(smi):
            ents.append("S" + smi.strip())
            if skeleton_key(smi):
                ents.append("R" + skeleton_key(smi))
        find(m)
        for e in ents:
            root[find(e)] = find(m)
    return {m: find(m) for m, _, _ in rows}


def test_p3_found_by_brute_force(spark, sf):
    from quillwork.llm.q_compounds import p3_found
    from quillwork.session import table

    rows = [tuple(r) for r in table(spark, sf, "compound_structures").select("molregno", "canonical_smiles", "standard_inchi_key").collect()]
    raw = [tuple(r) for r in table(spark, sf, "compound_bioactivity_raw").select("molregno", "inchikey_connectivity").distinct().collect()]
    comp = _brute_components(rows, raw)
    last = {}
    for m, name, at in table(spark, sf, "split_draft").select("molregno", "split_name", "assigned_at").collect():
        k = (at, name is not None, name or "")
        if m not in last or k > last[m][0]:
            last[m] = (k, name)
    split = {m: {"tr": 0, "va": 1, "te": 2}[n.strip().lower()[:2]] for m, (_, n) in last.items() if n and n.strip().lower()[:2] in ("tr", "va", "te") and m in comp}
    seen = {}
    for m, s in split.items():
        seen.setdefault(comp[m], set()).add(s)
    assert {r.molregno for r in p3_found(spark, sf).collect()} == {m for m in split if len(seen[comp[m]]) > 1}


def test_torn_edges(spark):
    draft = spark.createDataFrame([(1, "Train ", T[0]), (1, None, T[1]), (2, " TEST", T[0]), (3, "valid", T[0]), (4, "training", T[0]), (4, "test", T[2]), (5, "?", T[0]), (None, "test", T[0])], "molregno bigint, split_name string, assigned_at timestamp_ntz")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)], "molregno bigint, component bigint")
    assert {r.molregno for r in splits.torn(draft, comp).collect()} == {3, 4}
    assert splits.torn(draft.limit(0), comp).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    df = spark.range(4000).select((F.when(F.col("id") < 1200, 7).otherwise(F.col("id") / 3)).cast("bigint").alias("component"), (F.col("id") % 3).alias("label"))
    df = df.unionByName(df.limit(60).select((F.col("component") + 10_000).alias("component"), F.lit(None).cast("bigint").alias("label")))
    out = splits.assign(df)
    assert out.count() == out.select("component").distinct().count() == df.select("component").distinct().count()
    n = {r["split"]: r["s"] for r in out.groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert abs(n["train"] / 4060 - 0.8) < 0.02 and abs(n["test"] / 4060 - 0.1) < 0.02
    again = {r.component: r["split"] for r in splits.assign(df).collect()}
    assert again == {r.component: r["split"] for r in out.collect()}


def test_assignment_edges(spark):
    e = spark.createDataFrame([], "component bigint, label int")
    assert splits.assign(e).count() == 0
    one = spark.createDataFrame([(1, None), (None, 1)], "component bigint, label int")
    assert [r["split"] for r in splits.assign(one).collect()] == ["train"]
    with pytest.raises(ValueError):
        splits.assign(one, {"a": 0.0})
