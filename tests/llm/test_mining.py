import math

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import mining
from siltstone.llm.queries import oracle_sql, queries
from tests.oracle import check

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string, near array<int>, dim int"


def plainly(rows, every=100):
    fine = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        if sum(x * x for x in ints) < 2**62:
            item = ((label + 1) % 10 if i % 7 == 0 else label, ints)
            fine[i] = min(item, fine.get(i, item))
    out = []
    for a, (label, v) in fine.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in fine.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if x[2]][:5]:
            window = [x for x in scores if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, r, i, -s, -n) for r, (n, i, _) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows, every=100, **sizes):
    df = spark.createDataFrame([(*r, 1, "s", [1], 9) for r in rows], SCHEMA)
    got = mining.hard_negatives(df, F.pmod("vec_id", F.lit(every)) == 0, mining.moved_label(), **sizes)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_matches_sql(spark, tiny):
    assert check(queries()["op12_mining"](spark, tiny), oracle_sql()["op12_mining"], tiny) > 0


def test_lengths_of_all_sizes_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=6)
    rows = [(i, ((near + rng.normal(size=6) * 0.4) * rng.lognormal(0, 1)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows[50:90] = [(i, rows[40][1], i % 3) for i in range(50, 90)]
    expected = plainly(rows, 20)
    assert len(expected) > 200
    for sizes in ({}, {"bucket": 16, "stripe": 2, "block": 3}):
        assert found(spark, rows, 20, **sizes) == expected


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.5], 3), (1, [0.9, 0.4], 3), (2, [0.8, 0.5], 4), (3, None, 4), (4, [None, 1.0], 4), (5, [math.nan, 1.0], 4), (6, [math.inf, 1.0], 4), (8, [0.8, 0.5], None), (9, [1.0, 0.5, 2.0], 4)]
    rows += [(None, [0.8, 0.5], 4), (10, [1e30, 1.0], 4), (11, [0.8, 0.5], 4), (11, [0.8, 0.5], 4), (12, [0.0, 0.0], 4), (13, [], 4), (2, [0.1, 0.1], 5), (100, [0.8, 0.5], 4), (200, [-1.0, -0.5], 3)]
    assert found(spark, rows) == plainly(rows) != []
    assert found(spark, []) == []


def test_scores_beyond_floats(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=3) * 2.0**21).tolist(), i % 2) for i in range(60)]
    expected = plainly(rows, 10)
    assert found(spark, rows, 10) == expected and max(r[4] for r in expected) > 2**53


def test_short_buckets_are_passed_over(monkeypatch):
    """Once the windows are full, buckets too short to reach them aren't multiplied."""
    import pandas as pd

    multiplied = []
    real = mining.products
    monkeypatch.setattr(mining, "products", lambda a, b, most: (multiplied.append(len(b)), real(a, b, most))[1])

    def bucket(k, length, n):
        vectors = np.full((n, 2), length, np.int16)
        return (k, 2, 2 * length * length, (np.arange(n) + 10 * k + 1).astype("<i8").tobytes(), np.ones(n, "<i8").tobytes(), vectors.tobytes(), 2)

    right = pd.DataFrame([bucket(1, 5, 6), bucket(2, 100, 6), bucket(3, 4, 6)], columns=["bucket", "dim", "top", "ids", "labels", "vectors", "width"])
    left = pd.DataFrame({"vec_id": [0], "label": [1], "vector": [[10, 10]], "dim": [2], "norm2": [200], "low": [[-(2**63)]], "high": [[2**63 - 1]]})
    got = mining.search(left, right, True, 5)
    assert multiplied == [6] and got["id"].tolist() == [21, 22, 23, 24, 25]
