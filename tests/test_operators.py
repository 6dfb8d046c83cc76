"""Operators on small tables against plain Python: groups by any name, unequal lengths, missing pairs, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.operators import align, inference, pairs, panel, patterns
from statewise.sources import shared, tables


def _seq(spark, names=("x", "y"), seed=3):
    rng = np.random.default_rng(seed)
    rows = [(u, t, int(rng.integers(0, 3)), names[u % len(names)], float(rng.normal())) for u in range(7) for t in range(int(rng.integers(5, 12)))]
    return rows, spark.createDataFrame(rows, "subject long, t long, state int, grp string, x double")


def test_pairs_over_the_steps_that_both_have(spark):
    rows, seq = _seq(spark)
    state = {(u, t): s for u, t, s, _, _ in rows}
    want, tables_ = {}, {}
    for a in range(7):
        for b in range(a + 1, 7):
            both = [(state[a, t], state[b, t]) for t in range(20) if (a, t) in state and (b, t) in state]
            x, y = np.array(both, float).T
            want[a, b] = (np.mean(x == y), np.corrcoef(x, y)[0, 1] if x.std() and y.std() else None)
            n = np.zeros((3, 3))
            np.add.at(n, (x.astype(int), y.astype(int)), 1)
            p = n / n.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                tables_[a, b] = np.nansum(p * np.log(p / np.outer(p.sum(1), p.sum(0))))
    for block_rows in (512, 2):
        sums = pairs.pair_sums(seq.select(F.col("subject").alias("id"), F.col("t").alias("at"), F.col("state").alias("v")), equal=True, block_rows=block_rows)
        got = {(r["a"], r["b"]): (r["equal"] / r["n"], r["c"]) for r in sums.select("*", pairs._pearson().alias("c")).collect()}
        assert set(got) == set(want)
        for k, (share, corr) in want.items():
            assert abs(got[k][0] - share) < 1e-12 and (corr is None) == (got[k][1] is None) and (corr is None or abs(got[k][1] - corr) < 1e-9)
        counts = pairs.pair_counts(seq.select(F.col("subject").alias("id"), F.col("t").alias("at"), F.col("state").alias("v")), block_rows=block_rows)
        mi = {(r["a"], r["b"]): r["mutual_info"] for r in pairs.mutual_information(counts, ["a", "b"], "x", "y").collect()}
        assert all(abs(mi[k] - v) < 1e-9 for k, v in tables_.items())


def test_separation_counts_every_pair(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5, (12, 6)).astype(float)
    v[3] = 2.0  # no variance: correlation 0 with all
    label = np.arange(12) % 3

    def ranks(x):
        return np.array([np.sum(x < a) + (np.sum(x == a) + 1) / 2 for a in x])

    r = np.array([ranks(x) for x in v])
    rho = np.array([[0.0 if not (a.std() and b.std()) else np.corrcoef(a, b)[0, 1] for b in r] for a in r])
    within = [1 - rho[i, j] for i in range(12) for j in range(i) if label[i] == label[j]]
    between = [1 - rho[i, j] for i in range(12) for j in range(i) if label[i] != label[j]]
    vectors = spark.createDataFrame([(i, f, float(v[i, f])) for i in range(12) for f in range(6)], "id long, feature int, value double")
    labels = spark.createDataFrame([(i, int(label[i])) for i in range(12)], "id long, cluster int")
    got = pairs.rank_separation(vectors, labels).first()
    assert abs(got["within"] - np.mean(within)) < 1e-9 and abs(got["between"] - np.mean(between)) < 1e-9
    assert abs(got["ratio"] - np.mean(between) / np.mean(within)) < 1e-9 and abs(got["within_correlation"] - (1 - np.mean(within))) < 1e-9
    # Jaccard: pairs without a common feature are at distance 1
    sets = {0: {1, 2}, 1: {2, 3}, 2: {9}, 3: {9, 1}}
    patterns_ = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "pattern_id long, feature int")
    homes = spark.createDataFrame([(0, "p"), (1, "p"), (2, "p"), (3, "q")], "pattern_id long, cluster string")
    got = pairs.separation_ratio(pairs.jaccard_pairs(patterns_), homes).first()
    assert abs(got["within"] - (2 / 3 + 1 + 1) / 3) < 1e-9 and abs(got["between"] - (2 / 3 + 1 + 1 / 2) / 3) < 1e-9


@pytest.mark.parametrize("names", [("x", "y"), ("late", "early")])
def test_groups_may_have_any_name(spark, names):
    rows, seq = _seq(spark, names)
    _, usual = _seq(spark, ("a", "b") if names[0] < names[1] else ("b", "a"))
    y, z = panel.target_indicator(seq, 1), panel.target_indicator(usual, 1)
    for f in (inference.timepoint_t, pairs.group_distance, lambda p: inference.permutation_test(p, 5), lambda p: inference.timepoint_p(p)):
        one, two = f(y), f(z)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 0
    loo = lambda df: df.groupBy(F.col("state").alias("term"), "grp", "subject").agg(F.avg("x").alias("coef"))
    assert sorted(map(str, inference.loo_summary(loo(seq)).collect())) == sorted(map(str, inference.loo_summary(loo(usual)).collect()))
    turned = inference.timepoint_t(y, (max(names), min(names))).filter("t_stat is not null and t_stat <> 0").collect()
    straight = {r["t"]: r["t_stat"] for r in inference.timepoint_t(y).collect()}
    assert turned and all(abs(r["t_stat"] + straight[r["t"]]) < 1e-12 for r in turned)


def test_three_groups_are_an_error(spark):
    _, seq = _seq(spark, ("x", "y", "z"))
    y = panel.target_indicator(seq, 1)
    features = y.groupBy("t").agg(F.lit(1).alias("f"))
    for f in (inference.timepoint_t, pairs.group_distance, lambda p: panel.design_matrix(p, features, ["f"])):
        with pytest.raises(ValueError):
            f(y)
    members = spark.createDataFrame([(1, 1, "x", 0.5), (2, 1, "z", 0.25), (3, 2, "y", 1.0)], "id long, cluster int, grp string, occupancy double")
    got = {r["cluster"]: r for r in patterns.cluster_summary(members, ("x", "y", "z")).collect()}
    assert (got[1]["n_x"], got[1]["n_y"], got[1]["n_z"], got[1]["groups"]) == (1, 0, 1, "x,z") and got[2]["n_y"] == 1
    assert [r["cluster"] for r in patterns.cluster_overlap(members, ("x", "y", "z")).collect()] == [1]
    assert {r["id"]: r["number"] for r in patterns.renumbered(members).collect()} == {1: 2, 2: 2, 3: 1}


def test_permutation_metrics(spark):
    rows = [(u, t, "ab"[u % 2], int((u + t) % 3 == 0 or u % 2 and t > 2)) for u in range(8) for t in range(6 + u % 3)]
    y = spark.createDataFrame(rows, "subject long, t long, grp string, y int")
    course = {g: [np.mean([v for u, s, h, v in rows if h == g and s == t]) for t in range(8) if {h for _, s, h, _ in rows if s == t} == {"a", "b"}] for g in "ab"}
    a, b = np.array(course["a"]), np.array(course["b"])
    want = {"euclidean": np.linalg.norm(a - b), "correlation": 1 - np.corrcoef(a, b)[0, 1], "absolute_mean": np.abs(a - b).mean()}
    for metric, value in want.items():
        r = inference.permutation_test(y, 40, 1, metric).first()
        assert abs(r["observed"] - value) < 1e-9 and 0 <= r["p_value"] <= 1 and 0 <= r["percentile"] <= 100
        assert abs(r["fold_change"] - r["observed"] / r["null_mean"]) < 1e-9
        assert abs(r["percentile"] - 100 * (1 - r["p_value"])) <= 50  # apart by half of the ties


def test_peaks_by_series_against_a_search_of_the_bases(spark):
    rng = np.random.default_rng(9)
    series = {k: rng.integers(0, 6, n).astype(float) for k, n in (("p", 60), ("q", 3), ("r", 1), ("s", 25))}
    want = set()
    for k, v in series.items():
        for i in range(1, len(v) - 1):
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
                lo = max([m for m in range(i) if v[m] > v[i]], default=-1)
                hi = min([m for m in range(j, len(v)) if v[m] > v[i]], default=len(v))
                want.add((k, (i + j) // 2, v[i] - max(v[lo + 1 : i].min(), v[j + 1 : hi].min())))
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "story string, bin int, agreement double")
    found = align.peaks(df, by="story")
    assert {(r["story"], r["bin"], r["prominence"]) for r in found.collect()} == want
    swept = align.threshold_sweep(found, df, by="story").collect()
    assert {r["story"] for r in swept} == set(series)
    for r in swept:
        assert r["n_peaks"] == sum(k == r["story"] and p >= r["threshold"] for k, _, p in want)


def test_windows_and_bins_of_words(spark):
    words = spark.createDataFrame([("s", float(i), i, f"w{i}", i % 2 == 0, "n" if i < 5 else "m", "seg") for i in range(10)], "story string, onset double, word_id long, text string, is_even boolean, main_char string, seg string")
    windows = spark.createDataFrame([("s", 0.0, 3.0), ("s", 3.0, 3.0), ("s", 2.0, 8.5)], "story string, begin double, end double")
    texts = lambda closed: {(r["begin"], r["end"]): r["text"] for r in align.events_to_text(words, windows, closed=closed, width=2.0).collect()}
    assert texts("both") == {(0.0, 3.0): "w0 w1 w2 w3", (3.0, 3.0): "w3", (2.0, 8.5): "w2 w3 w4 w5 w6 w7 w8"}
    assert texts("left") == {(0.0, 3.0): "w0 w1 w2", (2.0, 8.5): "w2 w3 w4 w5 w6 w7 w8"} and texts("right")[(0.0, 3.0)] == "w1 w2 w3"
    with pytest.raises(ValueError):
        texts("neither")
    binned = align.bin_majority(words.withColumn("speaker", F.lit("x")), ["is_even"], 4.0, lists={"evens": "is_even"}, modes=("speaker", "main_char"))
    got = {r["bin"]: r for r in align.dense_bins(binned, 4).collect()}
    assert [got[b]["evens"] for b in range(4)] == ["w0 w2", "w4 w6", "w8", "none"] and [got[b]["main_char"] for b in range(4)] == ["n", "m", "m", "none"]
    assert (got[3]["mostly_is_even"], got[3]["n_is_even"], got[3]["words"]) == (False, 0, "")
    with pytest.raises(ValueError):
        align.dense_bins(binned, 40)
    assert align.dense_bins(binned, 40, force=True).count() == 40


def test_member_lookup_lists_what_there_is(spark):
    members = spark.createDataFrame([(1, 5, "a", "m2"), (2, 5, "a", "m3"), (3, 5, "b", "m2")], "id long, cluster int, grp string, model string")
    assert [r["id"] for r in patterns.find_member(members, 5, "a", "m3").collect()] == [2]
    for args, said in (((6, "a", "m2"), "no cluster 6"), ((5, "c", "m2"), r"\['a', 'b'\]"), ((5, "a", "m9"), r"\['m2', 'm3'\]")):
        with pytest.raises(LookupError, match=said):
            patterns.find_member(members, *args)


def test_cohorts(spark, tmp_path):
    assert {tuple(r) for r in tables.cohort(spark, {"x": "s1, s2,,s1", "y": "s3"}).collect()} == {("s1", "x"), ("s2", "x"), ("s3", "y")}
    (tmp_path / "late.txt").write_text("s7\n\n s8 \n")
    assert {tuple(r) for r in tables.cohort_files(spark, str(tmp_path)).collect()} == {("s7", "late"), ("s8", "late")}


def test_orders_over_sorted_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "id long, v double").withColumns({"__at": F.lit(1), "__part": F.lit(2)}).repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["id"]: r["number"] for r in shared.numbered(df, F.desc("v"), F.col("id")).collect()}
    assert got == {i: n for n, (i, _) in enumerate(order)}
    total, want = 0.0, {}
    for n, (i, v) in enumerate(order):
        total += v
        want[i] = (total, n + 1)
    assert {r["id"]: (r["running"], r["number"]) for r in shared.running(df, F.col("v"), F.desc("v"), F.col("id")).collect()} == want
    assert shared.numbered(df.filter("id < 0"), F.col("id")).count() == 0


def test_top_interactions_and_best_models(spark):
    terms = spark.createDataFrame([("group_a_b_interaction", 0.4), ("group_c_interaction", 0.9), ("group_coded", 1.0), ("group_d_interaction", 0.4)], "term string, prob_positive double")
    assert [r["feature"] for r in inference.top_interactions(terms, 2).collect()] == ["c", "a_b"]
    models = spark.createDataFrame([(3, 1.0, 5.0), (2, 1.0, None), (4, float("nan"), 2.0)], "model int, score double, loss double")
    assert {(r["metric"], r["model"], r["value"]) for r in inference.best_models(models, {"score": True, "loss": False}).collect()} == {("score", 2, 1.0), ("loss", 4, 2.0)}


def test_missing_values_are_violations(spark):
    rows = [(1, 0, 1.0, 0, 1, None), (1, 1, 2.0, None, None, 5), (2, 0, 1.0, 2, 0, 0)]
    got = panel.panel_checks(spark.createDataFrame(rows, "subject long, t long, x double, state int, f int, g int"), [0, 1, 2], ["f", "g"]).first()
    assert (got["n_subjects"], got["length_gap"], got["not_finite"], got["bad_labels"], got["not_binary"]) == (2, 1, 0, 1, 3)


def test_bins_past_and_short_of_the_expected_ones_stay(spark):
    binned = spark.createDataFrame([("p", 0, True, "x"), ("p", 4, True, "y"), ("q", 1, False, "z")], "story string, bin int, has_f boolean, words string")
    sizes = spark.createDataFrame([("p", 3), ("q", 6)], "story string, size int")
    got = align.dense_bins(binned, sizes)
    assert {r["story"]: r["n"] for r in got.groupBy("story").agg(F.count("*").alias("n")).collect()} == {"p": 5, "q": 6}
    for wrong in (spark.createDataFrame([("p", 30), ("q", 6)], "story string, size int"), sizes.filter("story = 'p'")):
        with pytest.raises(ValueError):
            align.dense_bins(binned, wrong)
