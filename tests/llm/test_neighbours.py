import math

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import neighbours
from siltstone.llm.queries import oracle_sql, queries
from tests.oracle import check

SCHEMA = "vec_id long, embedding array<float>, score string, q int"


def plainly(rows, k):
    fine = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in fine:
        if i % 20 == 0:
            near = sorted((-float((v * w).sum()), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def found(df, k=20, **sizes):
    return sorted(tuple(r) for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, k, **sizes).collect())


def test_query_matches_sql(spark, tiny):
    check(queries()["op9_neighbours"](spark, tiny), oracle_sql()["op9_neighbours"], tiny)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.integers(-2, 3, 8)] for _ in range(200)]
    vectors[20] = vectors[40] = vectors[7]
    vectors[60:100] = [vectors[3]] * 40  # more copies than an answer holds
    vectors[5], vectors[6], vectors[8], vectors[9], vectors[11] = None, [0.0] * 8, [math.nan] * 8, [math.inf, *[0.0] * 7], [None, *[1.0] * 7]
    rows = [(i, v, "s", 1) for i, v in enumerate(vectors)] + [(None, vectors[3], "s", 1), (201, [1.0, 2.0], "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = plainly(rows, 20)
    for sizes in ({}, {"stripe": 30, "block": 3}):
        got = found(df, **sizes)
        assert [r[:3] for r in got] == [r[:3] for r in expected]
        assert np.allclose([r[3] for r in got], [r[3] for r in expected])


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], "", 1), (1, [0.5, 0.5], "", 1), (1, [0.5, 0.5], "", 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(0, 1, 1, 0.5)]
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_quantisation_bounds_lose_no_neighbour():
    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(30, 64)) * rng.lognormal(0, 2, (30, 1)), rng.normal(size=(9000, 64)) * rng.lognormal(0, 2, (9000, 1))
    rows, cols, scores = neighbours.tile(q, v, 20)
    exact = q @ v.T
    for i in range(30):
        best = set(np.argsort(-exact[i])[:20].tolist())
        assert best <= set(cols[rows == i].tolist())
    assert np.allclose(scores, exact[rows, cols])
