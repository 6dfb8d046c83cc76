"""The thresholded pattern join against all pairs, and the links-only dendrogram against one over all pairs."""

import numpy as np
import pytest

from statewise.operators import clustering, pairs


def _sets(n, seed, width=40):
    """Groups of like sets over features of very unequal frequency, one of them in nearly all."""
    rng = np.random.default_rng(seed)
    centres = [set(np.flatnonzero(rng.random(width) < 0.25).tolist()) for _ in range(n // 10)]
    sets = {}
    for i in range(n):
        own = set(centres[i % len(centres)]) ^ set(rng.integers(0, width, rng.integers(0, 5)).tolist())
        sets[i] = (own | {width} if rng.random() < 0.95 else own) or {width}
    return sets


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "item long, features array<int>")


@pytest.mark.parametrize("least, list_rows", [(0.3, 4096), (0.5, 3), (0.8, 1), (1.0, 4096)])
def test_join_equals_all_pairs(spark, least, list_rows):
    sets = _sets(160, 3)
    got = [(r["a"], r["b"], r["similarity"]) for r in pairs.similar_patterns(_frame(spark, sets), least, list_rows).collect()]
    want = {(i, j): _jaccard(sets[i], sets[j]) for i in sets for j in sets if i < j}
    want = {p: v for p, v in want.items() if v >= least - 1e-12}
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} == set(want)
    assert all(abs(v - want[a, b]) < 1e-12 for a, b, v in got)


def test_join_of_nothing(spark):
    assert pairs.similar_patterns(_frame(spark, {0: {1}}).filter("item < 0"), 0.5).count() == 0
    with pytest.raises(ValueError, match="least"):
        pairs.similar_patterns(_frame(spark, {0: {1}}), 0.0)


def _rounds(sets, least):
    """(old, new, height) by rounds of reciprocal nearest neighbours over the means of all pairs."""
    of, out = {i: [i] for i in sets}, []
    sim = {(i, j): _jaccard(sets[i], sets[j]) for i in sets for j in sets}
    while True:
        mean = {a: {b: float(np.mean([sim[i, j] for i in of[a] for j in of[b]])) for b in of if b != a} for a in of}
        near = {a: min(((-round(m, 12), b) for b, m in mean[a].items() if m >= least - 1e-12), default=(0, None))[1] for a in of}
        met = [(b, a) for a, b in near.items() if b is not None and near[b] == a and a < b]
        if not met:
            return out
        out += [(old, new, mean[new][old]) for old, new in met]
        for old, new in met:
            of[new] += of.pop(old)


def test_linkage_makes_fewer_pairs_with_the_same_merges(spark):
    least, sets = 0.35, _sets(60, 7)
    sets = {i: s for i, s in sets.items() if not any(sets[j] == s for j in range(i))}  # a weight of one each
    rows = spark.createDataFrame([(i, int(f)) for i, s in sets.items() for f in s], "pattern_id long, feature int")
    made: list[int] = []
    _, merges = clustering.linkage_merges(rows, least, made=made)
    got, want = sorted(tuple(r) for r in merges.select("old", "new", "height").collect()), sorted(_rounds(sets, least))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert len(want) > 20 and sum(made) < len(sets) * (len(sets) - 1) / 2
