"""Values carried over sorted parts against plain loops, with parts of few rows."""

import random

import pytest
from pyspark.sql import functions as F

from statewise.operators import inference
from statewise.sources.shared import scanned


@pytest.fixture
def small_parts(spark):
    """Parts of few rows, which Spark would otherwise join."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_scans_equal_loops(spark, small_parts):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(9)])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    kinds = {f"s_{kind}": (kind, F.col("v")) for kind in ("last", "min", "max", "previous")}
    got = {r["k"]: r for r in scanned(df, kinds, F.col("k")).collect()}
    assert len(got) == 200
    before, seen, last = None, [], None
    for k, v in sorted(rows):
        seen, last = seen + [v] * (v is not None), last if v is None else v
        assert (got[k]["v"], got[k]["s_last"], got[k]["s_previous"]) == (v, last, before)
        assert (got[k]["s_min"], got[k]["s_max"]) == (min(seen, default=None), max(seen, default=None))
        before = v
    assert scanned(df.filter("k < 0"), kinds, F.col("k")).count() == 0


def test_bh_fdr_equals_the_definition(spark, small_parts):
    rng = random.Random(5)
    p = [round(rng.random() ** 2, 2) for _ in range(120)]  # with ties
    df = spark.createDataFrame([(t, v) for t, v in enumerate(p)], "t int, p double").repartition(4)
    got = {r["t"]: r["q"] for r in inference.bh_fdr(df).collect()}
    order = sorted(range(120), key=lambda t: (p[t], t))
    want, least = {}, 1.0
    for rank in range(120, 0, -1):
        least = min(least, p[order[rank - 1]] * 120 / rank)
        want[order[rank - 1]] = least
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)
