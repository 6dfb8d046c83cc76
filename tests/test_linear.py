"""Batched linear algebra of models against one model at a time."""

import numpy as np
from pyspark.sql import functions as F

from statewise.models import diagnostics, hmm, linear


def test_separability_equals_one_model_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(m, int(s), [float(v) for v in rng.normal(s, 1 + m, 3)]) for m in range(5) for s in rng.integers(0, 2 + m % 3, 60)]
    rows += [(9, s, [1.0, 1.0, float(s)]) for s in (0, 0, 1, 1)] + [(10, 4, [0.0, 1.0, 2.0])]
    got = {(r["subject"], r["a"], r["b"]): r for r in linear.separability(linear.state_moments(spark.createDataFrame(rows, "subject int, state int, x array<double>"), 3)).collect()}
    assert (9, 0, 1) in got and all(k[0] != 10 for k in got)
    assert got[9, 0, 1]["mahalanobis"] == np.sqrt(1 / 1e-6) or abs(got[9, 0, 1]["mahalanobis"] - 1e3) < 1e-6
    for m in range(5):
        x, z = np.array([r[2] for r in rows if r[0] == m]), np.array([r[1] for r in rows if r[0] == m])
        k = z.max() + 1
        p = hmm.Params(np.full(k, 1 / k), np.eye(k), np.array([x[z == i].mean(0) for i in range(k)]), np.array([np.cov(x[z == i].T, bias=True) for i in range(k)]))
        for r in diagnostics.separability(spark, p, np.bincount(z).astype(float)).collect():
            one = got.pop((m, r["a"], r["b"]))
            assert abs(one["euclidean"] - r["euclidean"]) < 1e-9 and abs(one["mahalanobis"] - r["mahalanobis"]) < 1e-9
    assert set(got) == {(9, 0, 1)}


def test_mixing_equals_one_matrix_at_a_time(spark):
    rng = np.random.default_rng(8)
    counts = {m: rng.integers(0, 9, (4, 4)) for m in range(6)}
    counts[3][2] = 0  # never left
    rows = [(m, i, j, int(c[i, j])) for m, c in counts.items() for i in range(4) for j in range(4)]
    for r in linear.mixing(spark.createDataFrame(rows, "subject int, before int, after int, n long"), 4).collect():
        c = counts[r["subject"]].astype(float)
        p = np.array([row / row.sum() if row.sum() else np.eye(4)[i] for i, row in enumerate(c)])
        assert abs(r["mixing_rate"] - diagnostics.mixing_rate(p)) < 1e-9 and abs(r["second"] + r["mixing_rate"] - 1) < 1e-12


def test_empty(spark):
    none = spark.createDataFrame([], "subject int, before int, after int, n long, state int, x array<double>")
    assert linear.mixing(none, 3).count() == 0 and linear.separability(linear.state_moments(none, 2)).count() == 0
    assert linear.mixing(none.union(spark.range(1).select(F.lit(1), F.lit(0), F.lit(0), F.lit(5), F.lit(0), F.array(F.lit(0.0)))), 1).first()["mixing_rate"] == 1.0
