"""A subject's rows with the same features count as one row of so many trials; the design's rows are shuffled once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.models import glmm
from statewise.operators import panel
from statewise.plans.views import table, v_seq

SF = "/root/testdata/sf0.001"


def _repeated():
    """Rows of four subjects, 5 to 60 a subject with at most six different ones, and the same as trials."""
    rng = np.random.default_rng(8)
    long, short = [], []
    for n in (5, 60, 20, 33):
        kinds = np.column_stack([np.ones(6), rng.normal(size=(6, 2))])
        at, y = rng.integers(0, 6, n), (rng.random(n) < 0.4).astype(float)
        long.append((kinds[at], y))
        own = np.unique(at)
        short.append((kinds[own], np.array([y[at == i].sum() for i in own]), np.array([(at == i).sum() for i in own], float)))
    starts = lambda parts: np.cumsum([0, *[len(p[1]) for p in parts]])[:-1]
    return [np.concatenate(c) for c in zip(*long)], starts(long), [np.concatenate(c) for c in zip(*short)], starts(short)


def test_trials_give_the_sums_of_their_rows():
    (x, y), first, (few, k, trials), begin = _repeated()
    beta, cov = np.array([0.3, -1.0, 2.0]), np.diag([0.1, 0.2, 0.3]) + 0.02
    for each in (False, True):
        assert np.allclose(glmm.batch_stats(few, k, begin, beta, 0.7, each, trials=trials), glmm.batch_stats(x, y, first, beta, 0.7, each), atol=1e-8)
    assert np.allclose(glmm.batch_bound(few, k, begin, beta, cov, 0.7, trials=trials), glmm.batch_bound(x, y, first, beta, cov, 0.7), atol=1e-7)


def test_alike_rows_are_packed_as_one(spark):
    rng = np.random.default_rng(3)
    rows = [(s, s % 3, float(rng.integers(0, 2)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for s in range(12) for _ in range(40)]
    rows += [(12, 0, 1.0, 0, 1), (12, 0, 1.0, 0, None), (12, 0, 0.0, 0, 1), (12, 0, None, 0, 1)]
    packed, at = glmm._packed(spark.createDataFrame(rows, "subject long, fold int, f double, g int, y int"), {"m": ["f", "g"], "f": ["f"]}, {"m": 0})
    assert at == {"f": 2, "g": 3}
    want = {}
    for s, fold, f, g, y in rows:
        seen = want.setdefault((s, fold), {}).setdefault((f, float(g)), [])
        seen.append(y)
    want = sorted((fold, sorted(str((None if None in ys else float(sum(ys)), float(len(ys)), *key)) for key, ys in kinds.items())) for (_, fold), kinds in want.items())
    got = sorted((r["fold"], sorted(str(tuple(r["rows"][i : i + 4])) for i in range(0, len(r["rows"]), 4))) for r in packed.collect())
    assert got == want


def test_columns_of_the_same_names_as_the_packed_ones(spark):
    rows = [(s, float(s % 2), float(i % 3), int((s + i) % 4 < 2)) for s in range(9) for i in range(12)]
    as_named = lambda a, b: glmm.fit(spark.createDataFrame(rows, f"subject long, {a} double, {b} double, y int"), {"m": [a, b]})["m"]["coef"]
    assert np.allclose(as_named("trials", "f2"), as_named("u", "v"))


def test_view_of_events(spark):
    places, want = {}, []
    for r in table(spark, SF, "events").orderBy("ts", "event_id").collect():
        t = places[r["user_id"]] = places.get(r["user_id"], -1) + 1
        want.append((r["user_id"], t, ["click", "error", "purchase", "signup", "view"].index(r["event_type"]), "ab"[r["user_id"] % 2], r["value"]))
    assert v_seq(spark, SF).columns == ["subject", "t", "state", "grp", "x"]
    assert sorted(map(tuple, v_seq(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_design_is_shuffled_once(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        seq = v_seq(spark, SF)
        feature = seq.groupBy("t").agg(F.avg("state").alias("f"))
        design = panel.design_matrix(panel.target_indicator(seq, 1).select("subject", "grp", "t", "y"), feature, ["f"], groups=("a", "b"))
        plan = design.groupBy("subject", "f").count().groupBy("subject").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    steps, series = plan.count("hashpartitioning(t#"), plan.count("Exchange hashpartitioning") - plan.count("hashpartitioning(t#")
    assert (steps, series) == (1, 2)  # steps of the features; subjects once for the panel and once, the same, for the features
