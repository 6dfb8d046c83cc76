"""Mixed models work subjects side by side: the same sums as one by one."""

import numpy as np
import pyarrow as pa

from statewise.models import glmm


def _one(x, y, beta, var):
    """The sums of one subject, its intercept's mode found by bisection."""
    eta = x @ beta
    slope = lambda b: (y - 1 / (1 + np.exp(-(eta + b)))).sum() - b / var
    low, high = -50.0, 50.0
    for _ in range(200):
        b = (low + high) / 2
        low, high = (b, high) if slope(b) > 0 else (low, b)
    p = 1 / (1 + np.exp(-(eta + b)))
    w = p * (1 - p)
    own, xw = w.sum() + 1 / var, x.T @ w
    hessian = (x * w[:, None]).T @ x - np.outer(xw, xw) / own
    ll = np.log(np.where(y > 0, p, 1 - p)).sum() - b * b / (2 * var)
    return np.concatenate([x.T @ (y - p), hessian.ravel(), [-0.5 * np.log(var * own), ll, b * b + 1 / own, 1.0]])


def _subjects():
    rng = np.random.default_rng(4)
    sizes = [1, 7, 40, 3, 200, 2]
    x = np.column_stack([np.ones(sum(sizes)), rng.normal(size=(sum(sizes), 2))])
    y = (rng.random(len(x)) < np.repeat([0.0, 0.3, 0.9, 1.0, 0.5, 0.5], sizes)).astype(float)
    return x, y, np.cumsum(sizes) - sizes


def test_newton_sums():
    x, y, first = _subjects()
    beta = np.array([0.3, -1.0, 2.0])
    want = np.array([_one(a, b, beta, 0.7) for a, b in zip(np.split(x, first[1:]), np.split(y, first[1:]))])
    assert np.allclose(glmm.batch_stats(x, y, first, beta, 0.7, each=True), want, atol=1e-8)
    assert np.allclose(glmm.batch_stats(x, y, first, beta, 0.7), want.sum(0), atol=1e-8)


def test_bound_sums():
    x, y, first = _subjects()
    mean, cov = np.array([0.3, -1.0, 2.0]), np.diag([0.1, 0.2, 0.3]) + 0.02
    want = sum(glmm.subject_bound(a, b, mean, cov, 0.7) for a, b in zip(np.split(x, first[1:]), np.split(y, first[1:])))
    assert np.allclose(glmm.batch_bound(x, y, first, mean, cov, 0.7), want, atol=1e-8)


def test_models_do_not_depend_on_how_many_subjects_go_together(spark):
    rng = np.random.default_rng(2)
    rows = [(s, s % 3, float(rng.normal()), int(rng.random() < 0.2 + 0.5 * (s % 2))) for s in range(30) for _ in range(int(rng.integers(1, 30)))]
    data, terms, out = spark.createDataFrame(rows, "subject long, fold int, f double, y int"), {"0": ["f"], "whole": ["f"]}, {"0": 0}
    together = glmm.fit(data, terms, left_out=out)
    without = glmm.fit(data.filter("fold <> 0"), {"m": ["f"]})["m"]
    assert np.allclose(together["0"]["coef"], without["coef"]) and np.allclose(together["0"]["sd"], without["sd"])
    sizes = [n for _, n in sorted({s: sum(r[0] == s for r in rows) for s in range(30)}.items())]
    flat = [[v for r in rows if r[0] == s for v in (float(r[3]), r[2])] for s in range(30)]
    packed = pa.RecordBatch.from_pydict({"fold": pa.array([None, *range(29)], pa.int32()), "rows": pa.array(flat, pa.list_(pa.float64()))})
    for limit in (1, 25, 10**6):
        some = list(glmm._tables(packed.slice(3), 2, limit))
        assert np.concatenate([np.diff(first, append=len(t)) for _, first, t in some]).tolist() == sizes[3:]
        assert np.concatenate([t for _, _, t in some]).ravel().tolist() == sum(flat[3:], [])
        assert np.concatenate([f for f, _, _ in some]).tolist() == list(range(2, 29))
