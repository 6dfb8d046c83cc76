"""Products of blocks: a task gives its pairs piece by piece, nothing about pairs is shuffled, and rounding by arithmetic is rounding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.operators import pairs
from statewise.plans import queries as core

SF = "/root/testdata/sf0.001"


def _series(spark):
    rng = np.random.default_rng(4)
    rows = [(s, t, int(rng.integers(0, 3))) for s in range(30) for t in range(s % 7, 12)]
    return spark.createDataFrame(rows, "subject long, t long, state int")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["pair_overlap", "pair_mi", "pair_coupling", "jaccard_pairs"])
def test_pairs_are_not_shuffled(spark, name):
    assert _exchanges(core.queries()[name](spark, SF)) == 1  # the vectors, dealt to their blocks


@pytest.mark.parametrize("operator", [pairs.pair_overlap, pairs.pair_mi])
def test_small_tiles_and_blocks_give_the_same_pairs(spark, monkeypatch, operator):
    want = {(r[0], r[1]): r[2] for r in operator(_series(spark)).collect()}
    monkeypatch.setattr(pairs, "_TILE", 16)
    monkeypatch.setattr(pairs, "_CELLS", 64)
    got = operator(_series(spark)).collect()
    assert len(got) == len(want) == 435 and all(r["a"] < r["b"] and abs(r[2] - want[r["a"], r["b"]]) < 1e-12 for r in got)


def test_separation_makes_no_pairs(spark):
    rng = np.random.default_rng(2)
    patterns = spark.createDataFrame([(p, int(f)) for p in range(90) for f in np.flatnonzero(rng.random(14) < 0.3)], "pattern_id long, feature int")
    labels = spark.createDataFrame([(p, p % 4) for p in range(95)], "pattern_id long, cluster long")
    want = pairs.separation_ratio(pairs.jaccard_pairs(patterns), labels).first()
    got = pairs.jaccard_separation(patterns, labels)
    assert all(abs(got.first()[c] - want[c]) < 1e-12 for c in ("within", "between", "ratio"))


@pytest.mark.parametrize("products", [True, False])
def test_similar_patterns_both_ways(spark, products):
    rng = np.random.default_rng(6)
    sets = {i: set(np.flatnonzero(rng.random(12) < 0.5).tolist()) | {12} for i in range(80)}
    items = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "item long, features array<int>")
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.similar_patterns(items, 0.5, 16, products).collect()}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    want = {p: v for p, v in want.items() if v >= 0.5 - 1e-12}
    assert set(got) == set(want) and all(abs(got[p] - v) < 1e-12 for p, v in want.items())


def test_rounding_by_arithmetic_is_rounding(spark):
    rng = np.random.default_rng(1)
    halves = [k / 128 for k in range(-300, 300)] + [0.1234565, 1.0000005, 2.5e-7, 5e-7, -5e-7, -1e-9, 0.0, -0.0, 1e13 + 0.5, float("nan"), float("inf"), None]
    values = [float(x) for x in rng.normal(size=3000) * 10.0 ** rng.integers(-8, 9, 3000)] + [k / 1e7 for k in range(-400, 400, 5)] + halves
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", core._round6("x").alias("got"), F.round("x", 6).alias("want"))
    text = lambda c: F.col(c).cast("string")
    assert df.filter(~text("got").eqNullSafe(text("want"))).collect() == []


@pytest.mark.parametrize("name", ["pair_overlap", "pair_mi", "pair_coupling", "jaccard_pairs"])
def test_no_vector_is_written_once_for_each_block(spark, name):
    plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # tasks read two blocks; vectors are not multiplied before the shuffle


@pytest.mark.parametrize("most", [100, 1 << 22])
def test_equal_measures_stand_together(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "_SORTED", most)
    monkeypatch.setattr(pairs, "_TILE", 64)
    tiles = [{"a": np.arange(50), "m": np.random.default_rng(i).integers(-3, 4, 50) / 7} for i in range(8)]
    tiles[3]["m"][::5] = np.nan
    want = sorted((a, str(m)) for t in tiles for a, m in zip(t["a"].tolist(), t["m"].tolist()))
    got = [np.column_stack([np.asarray(t["a"]), np.asarray(t["m"])]) for t in pairs.alike_together(iter(tiles), "m")]
    rows = np.concatenate(got)
    assert sorted((int(a), str(m)) for a, m in rows.tolist()) == want
    changes = (np.diff(np.nan_to_num(rows[:, 1], nan=-9)) != 0).sum()
    assert changes < 8 * -(-400 // max(most, 100)) + 8 and list(pairs.alike_together(iter([]), "m")) == []


def test_measures_of_a_task_are_in_order(spark):
    got = pairs.pair_mi(_series(spark)).select("mutual_info", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    parts = {}
    for r in sorted(got, key=lambda r: r["at"]):
        parts.setdefault(r["p"], []).append(round(r["mutual_info"], 6))
    falls = sum(x > y for v in parts.values() for x, y in zip(v, v[1:]))
    assert len(got) == 435 and falls == 0
