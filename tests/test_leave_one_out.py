"""Leave-one-out by subtraction against refits, and the matching of states between folds."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from statewise.models import diagnostics, glmm, hmm


def _planted(subjects, steps):
    rng, rows = np.random.default_rng(3), []
    for s in range(subjects):
        state = s % 2
        for t in range(steps + s % 5):
            state = state if rng.random() < 0.85 else 1 - state
            rows.append((s, t, [float(rng.normal(6 + 2.5 * state, 1.0)), float(rng.normal(5 - 2 * state, 1.0))]))
    return rows


def test_models_without_a_subject_equal_refits(spark):
    rows = _planted(14, 40)
    data = spark.createDataFrame(rows, "subject long, t long, x array<double>").withColumn("fold", F.col("subject"))
    full, _ = hmm.fit(data, 2, restarts=1, tol=1e-10, ridge=1e-3)
    models = hmm.leave_out(data, full)
    got = {r["fold"]: hmm.unflatten(r["params"], 2, 2) for r in models.collect()}
    assert set(got) == set(range(14)) and all(r["converged"] for r in models.collect())
    refits = {s: full for s in (0, 5, 13)}
    for s in refits:
        params = {0: full}
        hmm._em(data.filter(F.col("subject") != s), params, 400, 1e-10, 1e-3)
        moved = np.abs(hmm._flat(params[0]) - hmm._flat(full)).max()
        assert np.abs(hmm._flat(got[s]) - hmm._flat(params[0])).max() < 0.1 * moved + 1e-4
    scores = {r["subject"]: r for r in hmm.score_folds(data, models, 2).collect()}
    x = np.stack([r[2] for r in rows if r[0] == 5])
    assert abs(scores[5]["log_likelihood"] - hmm.posteriors(x, got[5])[0]) < 1e-9 and scores[5]["path"] == hmm.viterbi(x, got[5]).tolist() and scores[5]["n"] == len(x)
    found = diagnostics.fold_reliability(hmm.fold_means(models, 2, 2), block_rows=4).collect()
    pairs = [diagnostics.reliability([got[a].mean, got[b].mean]) for a, b in itertools.combinations(range(14), 2)]
    assert {r["n_pairs"] for r in found} == {13} and abs(np.mean([r["reliability"] for r in found]) - np.mean(pairs)) < 1e-9


def test_folds_of_several_subjects(spark):
    data = spark.createDataFrame(_planted(12, 30), "subject long, t long, x array<double>").withColumn("fold", F.col("subject") % 6)
    full, _ = hmm.fit(data, 2, restarts=1, tol=1e-10, ridge=1e-3)
    models = hmm.leave_out(data, full)
    params = {0: full}
    hmm._em(data.filter("fold <> 2"), params, 400, 1e-10, 1e-3)
    got = hmm.unflatten(models.filter("fold = 2").first()["params"], 2, 2)
    moved = np.abs(hmm._flat(params[0]) - hmm._flat(full)).max()
    assert models.count() == 6 and np.abs(hmm._flat(got) - hmm._flat(params[0])).max() < 0.25 * moved + 1e-4


def test_mixed_models_without_a_subject_equal_refits(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(24):
        own = rng.normal(0, 0.6)
        rows += [(s, s, f := float(rng.integers(0, 2)), g := float(rng.normal()), int(rng.random() < 1 / (1 + np.exp(0.4 - f + 0.5 * g - own)))) for _ in range(25)]
    data = spark.createDataFrame(rows, "subject long, fold int, f double, g double, y int")
    full = glmm.fit(data, {"m": ["f", "g"]}, rounds=60)["m"]
    got = {(r["fold"], r["term"]): r for r in glmm.leave_one_out(data, ["f", "g"], rounds=60).collect()}
    assert len(got) == 72 and all(r["converged"] for r in got.values())
    refits = glmm.fit(data, {"0": ["f", "g"], "9": ["f", "g"]}, rounds=60, left_out={"0": 0, "9": 9})
    for fold in (0, 9):
        mine = np.array([got[(fold, t)]["coef"] for t in ("intercept", "f", "g")])
        moved = np.abs(refits[str(fold)]["coef"] - full["coef"]).max()
        assert np.abs(mine - refits[str(fold)]["coef"]).max() < 0.15 * moved + 1e-3


def test_matching_is_the_best_of_all_permutations():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5, 6):
        for _ in range(20):
            gain = rng.integers(-3, 4, (k, k)).astype(float) if _ % 2 else rng.normal(size=(k, k))
            best = max(sum(gain[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(k)))
            mine = diagnostics.best_matching(gain)
            assert sorted(mine) == list(range(k)) and abs(gain[np.arange(k), mine].sum() - best) < 1e-9
    big = rng.normal(size=(60, 60))
    order = rng.permutation(60)
    assert (diagnostics.best_matching(np.where(np.arange(60)[None] == order[:, None], 9.0, big)) == order).all()
