"""The grid of state numbers and cohorts against separate fits of its cells."""

import numpy as np
import pytest

from statewise.models import grid, hmm


def _rows(seed=5, subjects=8, steps=50):
    rng, rows = np.random.default_rng(seed), []
    for s in range(subjects):
        state, wide = 0, 2.0 if s % 2 else 1.0
        for t in range(steps + s):
            state = state if rng.random() < 0.9 else (state + 1) % 3
            rows.append((s, t, [float(rng.normal(1.2 * (state - 1), 0.2 * wide))], "ab"[s % 2]))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(_rows(), "subject long, t long, x array<double>, grp string").cache()


COHORTS = {"a": ["a"], "both": ["a", "b"], "none": ["z"]}


def test_cells_equal_separate_fits(data):
    got = {(r["cohort"], r["k"], r["restart"]): r for r in grid.fit_grid(data, [1, 3], COHORTS, restarts=2, most_rounds=10).collect()}
    assert {c for c, _, _ in got} == {"a", "both"} and len(got) == 8
    for (cohort, k, restart), r in got.items():
        one = {0: hmm.initial(k, 1, restart)}
        history = hmm._em(data.filter("grp = 'a'") if cohort == "a" else data, one, 10, 1e-3, 1e-6)
        assert len(history[0]) == r["rounds"] and one[0].converged == r["converged"]
        assert abs(history[0][-1] - r["log_likelihood"]) < 1e-7
        assert np.allclose(r["mean"], one[0].mean) and np.allclose(r["transition"], one[0].transition) and np.allclose(r["cov"], one[0].cov)


def test_selection(data):
    chosen = grid.selected(grid.fit_grid(data, [1, 2, 3], COHORTS, restarts=4, most_rounds=60)).collect()
    assert len(chosen) == 6
    by = {(r["cohort"], r["place"]): r["k"] for r in chosen}
    assert by["a", 1] == 3 and by["both", 1] == 3
    one = next(r for r in chosen if r["k"] == 1 and r["cohort"] == "a")
    x = np.array([r[2][0] for r in _rows() if r[3] == "a"])
    ll = -0.5 * len(x) * (np.log(2 * np.pi * x.var()) + 1)  # a single state is one normal distribution
    assert abs(one["log_likelihood"] - ll) < 1e-2 and one["n"] == len(x) and one["n_subjects"] == 4
    assert abs(one["bic"] - (2 * np.log(len(x)) - 2 * ll)) < 1e-1 and one["init_stability"] > 0.999


def test_unsettled_restart_is_not_preferred(spark):
    row = lambda r, ll, ok: ("a", 2, r, 1, 10, 1, ll, 5, ok, None, None, None, None)
    fits = spark.createDataFrame([row(0, -5.0, False), row(1, -7.0, True), row(2, -7.0, True)], grid._FITS)
    assert [r["restart"] for r in grid.selected(fits).collect()] == [1]
