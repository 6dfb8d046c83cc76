"""Iterative models: likelihood never falls, planted parameters come back, clustering equals greedy average linkage."""

import itertools

import numpy as np
import pytest

from statewise.models import diagnostics, glmm, hmm
from statewise.operators.clustering import average_linkage, linkage_sweep


def _planted(seed=1, subjects=6, steps=60):
    rng, rows = np.random.default_rng(seed), []
    for s in range(subjects):
        state = 0
        for t in range(steps):
            state = state if rng.random() < 0.9 else 1 - state
            rows.append((s, t, [float(rng.normal(4 * state)), float(rng.normal(-3 * state))], state))
    return rows


def test_hmm(spark):
    rows = _planted()
    data = spark.createDataFrame([r[:3] for r in rows], "subject long, t long, x array<double>")
    params, history = hmm.fit(data, 2, restarts=2, most_rounds=12)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert abs(sorted(params.mean[:, 0])[1] - 4) < 0.6
    got = {(r["subject"], r["t"]): r["state"] for r in hmm.decode(data, params).collect()}
    same = np.mean([got[(s, t)] == z for s, t, _, z in rows])
    assert max(same, 1 - same) > 0.95


def test_viterbi_and_likelihood_by_enumeration():
    p = hmm.initial(2, 1, 3)
    x = np.array([[0.1], [1.2], [-0.7], [2.0]])
    b = hmm.log_density(x, p)
    def total(z):
        return np.log(p.start[z[0]]) + b[0, z[0]] + sum(np.log(p.transition[z[t - 1], z[t]]) + b[t, z[t]] for t in range(1, 4))
    paths = list(itertools.product(range(2), repeat=4))
    scores = np.array([total(z) for z in paths])
    assert tuple(hmm.viterbi(x, p)) == paths[scores.argmax()]
    assert abs(hmm.posteriors(x, p)[0] - np.log(np.exp(scores).sum())) < 1e-9


def test_glmm(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(30):
        own = rng.normal(0, 0.7)
        for _ in range(60):
            f, g = float(rng.integers(0, 2)), float(rng.normal())
            rows.append((s, f, g, int(rng.random() < 1 / (1 + np.exp(-(-0.5 + 1.2 * f - 0.8 * g + own))))))
    data = spark.createDataFrame(rows, "subject long, f double, g double, y int")
    terms = {"both": ["f", "g"], "f": ["f"]}
    fitted = glmm.fit(data, terms)
    assert np.abs(fitted["both"]["gradient"]).max() < 1e-2
    assert np.abs(fitted["both"]["coef"][1:] - [1.2, -0.8]).max() < 0.35 and 0.4 < fitted["both"]["random_sd"] < 1.1
    assert glmm.term_table(spark, fitted, terms).count() == 5


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_average_linkage(spark, threshold):
    rng = np.random.default_rng(9)
    sets = {i: frozenset(np.flatnonzero(rng.random(7) < 0.6).tolist()) or frozenset([0]) for i in range(24)}
    clusters = [[i] for i in sets]
    far = lambda p, q: np.mean([1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in p for j in q])
    while len(clusters) > 1:
        d, i, j = min((round(far(p, q), 12), min(p), min(q), i, j)[0:1] + (i, j) for (i, p), (j, q) in itertools.combinations(enumerate(clusters), 2))
        if d > 1 - threshold + 1e-12:
            break
        clusters[i] = sorted(clusters[i] + clusters[j])
        del clusters[j]
    rows = [(i, f) for i, s in sets.items() for f in s]
    got = {r["pattern_id"]: r["cluster"] for r in average_linkage(spark.createDataFrame(rows, "pattern_id long, feature int"), threshold).collect()}
    sizes = lambda groups: sorted(map(len, groups))
    mine = [[p for p in got if got[p] == c] for c in set(got.values())]
    assert set(got) == set(sets)
    assert sum(sizes(mine)) == 24 and abs(len(mine) - len(clusters)) <= 1  # ties may be broken either way


def test_linkage_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(f)) for i in range(14) for f in np.flatnonzero(rng.random(6) < 0.5)]
    patterns = spark.createDataFrame(rows, "pattern_id long, feature int")
    swept = linkage_sweep(patterns, [0.5, 0.7]).collect()
    for threshold in (0.5, 0.7):
        alone = {tuple(r) for r in average_linkage(patterns, threshold).collect()}
        assert {(r["pattern_id"], r["cluster"]) for r in swept if r["threshold"] == threshold} == alone
    assert linkage_sweep(patterns.filter("pattern_id < 0"), [0.5]).count() == 0


def test_cross_validation(spark):
    rows = _planted(subjects=6, steps=40)
    # moved off the origin, where the mean of state 0 would have no direction to compare
    data = spark.createDataFrame([(s, t, [v + 5 for v in x], s % 3) for s, t, x, _ in rows], "subject long, t long, x array<double>, fold int")
    full, _ = hmm.fit(data, 2, restarts=1, most_rounds=8)
    params, scores = hmm.cross_validate(data, full, most_rounds=3)
    assert set(params) == {0, 1, 2} and scores.count() == 6
    # fold 0's model is that of the other subjects alone
    others = {0: full}
    hmm._em(data.filter("fold <> 0").drop("fold"), others, 3, 1e-3, 1e-3)
    assert np.allclose(others[0].mean, params[0].mean)
    assert diagnostics.reliability([p.mean for p in params.values()]) > 0.99
    mean = hmm.confusion(data, full).groupBy("decoded").sum("probability").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in mean)


def test_diagnostics(spark):
    rng = np.random.default_rng(3)
    gain = rng.random((5, 5))
    best = max(itertools.permutations(range(5)), key=lambda c: sum(gain[i, j] for i, j in enumerate(c)))
    assert tuple(diagnostics.best_matching(gain)) == best
    means = rng.standard_normal((4, 6))
    assert abs(diagnostics.reliability([means, means[[2, 0, 3, 1]]]) - 1) < 1e-9
    assert abs(diagnostics.mixing_rate(np.array([[0.9, 0.1], [0.3, 0.7]])) - 0.4) < 1e-12
    assert abs(diagnostics.confusion_entropy(np.full((2, 2), 0.5)) - 1) < 1e-12 and diagnostics.confusion_entropy(np.eye(3)) == 0
    p = hmm.initial(3, 2, 0)
    for r in diagnostics.separability(spark, p).collect():
        assert abs(r["euclidean"] - r["mahalanobis"]) < 1e-9  # identity covariances
    assert diagnostics.stability(spark, p, [-10.0, -10.0]).first()["init_stability"] == 1.0


def test_glmm_leave_out(spark):
    rng = np.random.default_rng(7)
    rows = [(s, s % 2, f := float(rng.integers(0, 2)), int(rng.random() < 0.3 + 0.3 * f)) for s in range(8) for _ in range(20)]
    data = spark.createDataFrame(rows, "subject long, fold int, f double, y int")
    got = {(r["fold"], r["term"]): r["coef"] for r in glmm.leave_out(data, ["f"], [0, 1], rounds=8).collect()}
    alone = glmm.fit(data.filter("fold = 1"), {"m": ["f"]}, rounds=8)["m"]["coef"]
    assert len(got) == 4 and abs(got[(0, "f")] - alone[1]) < 1e-6
