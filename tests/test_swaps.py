"""Compare-and-set from where the parents stand."""

from editstrata.operators import sequence


def test_present_revisions(spark):
    rows = [("p", 1, 0), ("p", 2, 7), ("p", 3, 7), ("p", 4, 8), ("q", 1, 0), ("q", 2, 1), ("q", 3, 5)]
    requests = spark.createDataFrame(rows, "parent_key string, arrival long, base long")
    stands = spark.createDataFrame([("p", 7), ("z", 3)], "parent_key string, revision long")
    got = {(r.parent_key, r.arrival): (r.accepted, r.current) for r in sequence.swaps(requests, revisions=stands).collect()}
    assert got == {("p", 1): (False, 7), ("p", 2): (True, 7), ("p", 3): (False, 8), ("p", 4): (True, 8), ("q", 1): (True, 0), ("q", 2): (True, 1), ("q", 3): (False, 2)}
    plain = {(r.parent_key, r.arrival): (r.accepted, r.current) for r in sequence.swaps(requests).collect()}
    assert plain["p", 1] == (True, 0) and plain["p", 2] == (False, 1)
