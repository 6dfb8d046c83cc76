"""Registered fits run until they settle, and say so."""

import numpy as np
import pytest

from statewise.models import glmm, hmm
from statewise.plans import queries as core

SF = "/root/testdata/sf0.001"


def test_series_side_by_side_equal_one_by_one():
    p, rng = hmm.initial(3, 2, 0), np.random.default_rng(1)
    series = [rng.standard_normal((n, 2)) for n in (1, 5, 9, 3, 40)]

    def one(x):
        ll, g, move = hmm.posteriors(x, p)
        return np.concatenate([[ll], g[0], move.ravel(), g.sum(0), (g.T @ x).ravel(), np.einsum("tk,ti,tj->kij", g, x, x).ravel()])

    want = sum(map(one, series))
    for cells in (1, 12, 1000):
        assert np.allclose(sum(hmm._statistics(some, p) for some in hmm._chunks(series, cells)), want)


def test_fits_tell_whether_they_settled(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, [float(rng.normal(5 * (t // 7 % 2)))], s % 2, int(rng.random() < 0.4)) for s in range(6) for t in range(40)]
    data = spark.createDataFrame(rows, "subject long, t long, x array<double>, fold int, y int")
    short, _ = hmm.fit(data, 2, restarts=1, most_rounds=2)
    whole, _ = hmm.fit(data, 2, restarts=1)
    with pytest.raises(RuntimeError):
        hmm.settled(whole, short)
    hmm.settled(whole)
    assert {r["converged"] for r in hmm.cross_validate(data, whole, most_rounds=1)[1].collect()} == {False}
    assert {r["converged"] for r in hmm.cross_validate(data, whole)[1].collect()} == {True}
    assert [glmm.fit(data, {"m": ["fold"]}, rounds=n)["m"]["converged"] for n in (2, 60)] == [False, True]


def test_registered_fits_settle(spark):
    assert core._fitted(spark, SF)[1].converged
    for name in ("glmm_terms", "glmm_folds"):
        assert {r["converged"] for r in core.queries()[name](spark, SF).collect()} == {True}
