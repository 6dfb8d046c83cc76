"""The dendrogram as a table: heights and sizes against the patterns themselves, cuts against each other."""

import numpy as np

from statewise.operators import clustering


def _patterns(spark, n=30, seed=4):
    rng = np.random.default_rng(seed)
    sets = {i: set(np.flatnonzero(rng.random(8) < 0.55).tolist()) or {0} for i in range(n)}
    sets[n], sets[n + 1] = {100}, {100}  # equal, and like no other
    return sets, spark.createDataFrame([(i, int(f)) for i, s in sets.items() for f in s], "pattern_id long, feature int")


def test_heights_are_mean_similarities(spark):
    sets, patterns = _patterns(spark)
    items, merges = clustering.linkage_merges(patterns, 0.2)
    of = {r["item"]: [i for i in sets if sets[i] == set(r["features"])] for r in items.collect()}
    rows = sorted(merges.collect(), key=lambda r: r["round"])
    assert len({r["old"] for r in rows}) == len(rows) > 5 and max(r["round"] for r in rows) > 0
    made = {}
    for r in rows:
        a, b = of.pop(r["old"]), of[r["new"]]
        mean = np.mean([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in a for j in b])
        assert abs(mean - r["height"]) < 1e-9 and r["size"] == len(a) + len(b) and min(a) > min(b)
        assert r["height"] <= min(made.get(r["old"], 1), made.get(r["new"], 1)) + 1e-9  # no inversions
        made[r["new"]], of[r["new"]] = r["height"], a + b
    left = [(p, q) for p in of for q in of if p < q]
    assert all(np.mean([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in of[p] for j in of[q]]) < 0.2 for p, q in left)


def test_cuts_follow_the_merges(spark):
    sets, patterns = _patterns(spark, seed=6)
    items, merges = clustering.linkage_merges(patterns, 0.2)
    rows = merges.collect()
    got = {(r["threshold"], r["item"]): r["cluster"] for r in clustering.cut(items, merges, [0.2, 0.5, 0.99]).collect()}
    for threshold in (0.2, 0.5, 0.99):
        up = {r["old"]: r["new"] for r in rows if r["height"] >= threshold}
        for (t, item), cluster in got.items():
            if t == threshold:
                while item in up:
                    item = up[item]
                assert cluster == item
    assert len({c for (t, _), c in got.items() if t == 0.2}) < len({c for (t, _), c in got.items() if t == 0.5}) < len({c for (t, _), c in got.items() if t == 0.99})
    none = clustering.linkage_merges(patterns.filter("pattern_id < 0"), 0.2)
    assert none[1].count() == 0 and clustering.cut(*none, [0.2]).count() == 0
