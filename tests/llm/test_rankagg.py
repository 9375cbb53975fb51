import datetime as dt
import math

import numpy as np
import pytest

from quern.llm.rankagg import beta_cdf, least_probability, ranking, stable_probability

T = dt.datetime(2025, 1, 1)
S = "query_id long, doc_id long, kw double, coverage double, tfidf double, vec double, scored_at timestamp"
W = "ranker string, k double, w_kw double, w_vec double"


def binomial(a, b, x):
    n = a + b - 1
    return sum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(a, n + 1))


def test_beta_against_binomial_sums_and_edges():
    grid = [(a, b, x) for a in range(1, 9) for b in range(1, 9) for x in (0.0, 1e-6, 0.1, 0.5, 0.93, 1.0)]
    a, b, x = map(np.array, zip(*grid))
    assert np.allclose(beta_cdf(a, b, x), [binomial(*g) for g in grid], rtol=1e-10, atol=1e-14)
    assert abs(beta_cdf([0.5], [0.5], [0.5])[0] - 0.5) < 1e-12


def test_weights_are_repeated_lists():
    r = np.random.default_rng(0).random((50, 4))
    once = least_probability(r, np.tile([1.0, 1, 1, 3], (50, 1)))
    again = least_probability(np.c_[r, r[:, 3], r[:, 3]], np.ones((50, 6)))
    assert np.allclose(once, again)


@pytest.mark.parametrize("cut", [10**6, 5])
def test_ranking_with_ties_absent_and_repeats(spark, cut):
    rows = [(1, d, float(d), float(10**d), d / 100, float(d % 3), T) for d in range(1, 12)]
    rows += [(1, 11, None, float("nan"), float("inf"), -1.0, T - dt.timedelta(1)), rows[3], (None, 1, 1.0, 1.0, 1.0, 1.0, T), (1, None, 1.0, 1.0, 1.0, 1.0, T)]
    rows += [(2, 5, None, 0.0, float("nan"), None, None), (2, 4, None, 2.0, 2.0, 2.0, T), (9, 1, 1.0, 1.0, 1.0, 1.0, T)]
    q = spark.createDataFrame([(1, "r"), (2, None)], "query_id long, ranker string")
    w = spark.createDataFrame([("r", 1.0, None, 2.0)], W)
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], S + ", significance double, n string")
    out = ranking(df, q, w, cut=cut).orderBy("query_id", "position").collect()
    assert [r.doc_id for r in out if r.query_id == 1][:2] == [11, 8] and len(out) == 13
    assert [(r.doc_id, r.position) for r in out if r.query_id == 2] == [(4, 1), (5, 2)] and out[-1].significance == 1.0
    top = ranking(df, q, w, 3, cut).count()
    assert top == 5 and ranking(df.limit(0), q, w).count() == 0


def test_slices_rank_as_one_sort(spark):
    r = np.random.default_rng(3)
    rows = [(1, d, float(r.integers(1, 40)), float(r.pareto(1)) + 1e-9, float(r.random()), float(r.integers(0, 2)), T) for d in range(600)]
    q, w = spark.createDataFrame([(1, "r")], "query_id long, ranker string"), spark.createDataFrame([("r", 1.0, 1.0, 2.0)], W)
    df = spark.createDataFrame(rows, S)
    assert ranking(df, q, w, cut=50).orderBy("position").collect() == ranking(df, q, w).orderBy("position").collect()


def test_stable_probability():
    r, w = np.random.default_rng(1).random((40, 4)), np.tile([1.0, 1, 1, 2], (40, 1))
    got = stable_probability(r, w)
    for i in range(40):
        logs = []
        for a in range(4):
            for b in range(a + 1, 4):
                (x, u), (y, v) = sorted([(r[i, a], int(w[i, a])), (r[i, b], int(w[i, b]))])
                logs.append(math.log(min(binomial(u, v + 1, x), binomial(u + v, 1, y))))
        assert math.isclose(got[i], math.exp(sum(logs) / 6), rel_tol=1e-9)
    # first, tenth, third and first of 40 come before third, third, twelfth and ninth
    a, b = stable_probability(np.array([[1, 10, 3, 1], [9, 9, 8, 3]]) / 40, np.ones((2, 4)))
    assert a < b
