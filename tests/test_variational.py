"""Variational fit of the mixed model: against quadrature, as the fallback of Newton, and evidences of nested models."""

import numpy as np
import pytest

from statewise.models import glmm


def _panel(seed, subjects, rows, effect=1.0, own=0.6):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(subjects):
        b = rng.normal(0, own)
        for _ in range(rows):
            f = float(rng.integers(0, 2))
            out.append((s, 1 if s % 2 else -1, f, int(rng.random() < 1 / (1 + np.exp(-(-0.3 + effect * f + b))))))
    return out


def _quadrature(rows, var, prior_sd):
    """Log evidence, means and deviations of intercept and effect, by a grid over both and Gauss-Hermite over each subject's intercept."""
    z, w = np.polynomial.hermite_e.hermegauss(60)
    w = w / w.sum()
    grid = np.linspace(-7, 7, 141)
    b0, b1 = np.meshgrid(grid, grid, indexing="ij")
    log = -(b0**2 + b1**2) / (2 * prior_sd**2) - np.log(2 * np.pi * prior_sd**2)
    for s in {r[0] for r in rows}:
        total = np.zeros((*b0.shape, len(z)))
        for _, _, f, y in (r for r in rows if r[0] == s):
            eta = b0[..., None] + b1[..., None] * f + np.sqrt(var) * z
            total += y * eta - np.logaddexp(0, eta)
        top = total.max(-1)
        log += top + np.log((np.exp(total - top[..., None]) * w).sum(-1))
    cell, top = (grid[1] - grid[0]) ** 2, log.max()
    p = np.exp(log - top)
    evidence = top + np.log(p.sum() * cell)
    p /= p.sum()
    mean = np.array([(p * b0).sum(), (p * b1).sum()])
    return evidence, mean, np.sqrt([(p * (b0 - mean[0]) ** 2).sum(), (p * (b1 - mean[1]) ** 2).sum()])


def test_a_subjects_bound_touches_from_below():
    rng = np.random.default_rng(0)
    x, y = np.column_stack([np.ones(15), rng.normal(size=15)]), rng.integers(0, 2, 15).astype(float)
    z, w = np.polynomial.hermite_e.hermegauss(80)
    mean, cov = np.array([0.2, -0.4]), np.eye(2) * 1e-6
    s = glmm.subject_bound(x, y, mean, cov, 0.5)
    for beta in (mean, mean + 1.5, mean - 2):
        eta = (x @ beta)[:, None] + np.sqrt(0.5) * z
        exact = np.log((np.exp((y[:, None] * eta - np.logaddexp(0, eta)).sum(0)) * w).sum() / w.sum())
        bound = s[:2] @ beta - 0.5 * beta @ s[2:6].reshape(2, 2) @ beta + s[-3]
        assert bound <= exact + 1e-9
    assert exact - bound < 60


@pytest.mark.parametrize("seed", [1, 2])
def test_against_quadrature(spark, seed):
    rows = _panel(seed, 6, 14)
    data = spark.createDataFrame(rows, "subject long, group_coded int, f double, y int")
    got = glmm.variational(data, {"m": ["f"]})["m"]
    assert got["converged"] and got["method"] == "variational"
    assert all(b >= a - 1e-9 for a, b in zip(got["bounds"], got["bounds"][1:]))
    evidence, mean, sd = _quadrature(rows, got["random_sd"] ** 2, 2.0)
    assert got["log_evidence"] <= evidence + 1e-6 and evidence - got["log_evidence"] < 0.6
    assert np.abs(got["coef"] - mean).max() < 0.15 * sd.max() and np.all(got["sd"] < 1.02 * sd) and np.all(got["sd"] > 0.8 * sd)
    newton = glmm.fit(data, {"m": ["f"]}, rounds=60)["m"]
    evidence, _, _ = _quadrature(rows, newton["random_sd"] ** 2, 2.0)
    assert newton["method"] == "newton" and abs(newton["log_evidence"] - evidence) < 0.2


def test_separated_data_fall_back_and_say_so(spark):
    rows = [(s, 1 if s % 2 else -1, float(t % 2), t % 2) for s in range(6) for t in range(12)]  # f decides y
    data = spark.createDataFrame(rows, "subject long, group_coded int, f double, y int")
    terms = {"f": ["f"], "null": ["group_coded"]}
    alone = glmm.fit(data, terms, prior_sd=1e8, rounds=6)
    assert not alone["f"]["converged"]
    got = glmm.fit(data, terms, prior_sd=1e8, rounds=6, fallback=True)
    assert got["f"]["method"] == "variational" and np.isfinite(got["f"]["coef"]).all()
    table = glmm.evidence_table(spark, got, terms, "null").collect()
    assert {r["model_id"]: r["method"] for r in table}["f"] == "variational"
    assert all(abs(r["evidence_gain"]) < 1e-12 for r in table if r["model_id"] == "null")


def test_evidence_prefers_the_model_that_made_the_data(spark):
    for effect, better in ((1.6, True), (0.0, False)):
        data = spark.createDataFrame(_panel(5, 20, 30, effect), "subject long, group_coded int, f double, y int").selectExpr("*", "group_coded * f AS group_f_interaction")
        terms = glmm.feature_sweep(["f"], [])
        assert set(terms) == {"f", "all", "null"}
        fitted = glmm.fit(data, terms, rounds=60, fallback=True)
        gain = {r["model_id"]: r["evidence_gain"] for r in glmm.evidence_table(spark, fitted, terms, "null").collect()}
        assert (gain["f"] > 0) == better and abs(gain["f"] - gain["all"]) < 1e-6
        bound = glmm.variational(data, terms)
        assert ((bound["f"]["log_evidence"] - bound["null"]["log_evidence"]) > 0) == better
