def test_fingerprint_query_has_every_bit(spark, sf):
    from quillwork.plans import similarity as plans
    from quillwork.plans.registry import Tables

    want = {r.id: sorted(r.bits) for r in plans._fingerprints(Tables(spark, sf)).collect()}
    got = {r.id: [int(b) for b in r.bits.split(",") if b] for r in plans.QUERIES["ml_12_circular_fingerprint"](spark, sf).collect()}
    assert got == want and max(map(len, got.values())) > 5
