"""Queries without a SQL form read whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.functions.tails import t_two_sided
from statewise.operators import inference
from statewise.plans import queries as core
from statewise.plans.views import table, v_seq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lengths(spark):
    return {r["user_id"]: r["count"] for r in table(spark, SF, "events").groupBy("user_id").count().collect()}


def test_series_are_whole(spark, lengths):
    assert v_seq(spark, SF).count() == sum(lengths.values())
    assert core._standardised(spark, SF).count() == sum(lengths.values())
    got = {r["t"]: r for r in core.queries()["timepoint_p"](spark, SF).collect()}
    assert set(got) == set(range(max(lengths.values())))
    for t, r in got.items():
        ends = [sum(n > t for u, n in lengths.items() if u % 2 == g) for g in (0, 1)]
        assert (r["p"] is None) == (min(ends) < 2) and (r["q"] is None) == (r["p"] is None)
    q = core.queries()["ljung_box_p"](spark, SF).filter("lag = 1").select("subject", "autocorrelation").collect()
    x = {}
    for r in table(spark, SF, "events").orderBy("ts", "event_id").collect():
        x.setdefault(r["user_id"], []).append(r["value"])
    for r in q:
        v = x[r["subject"]]
        d = [a - sum(v) / len(v) for a in v]
        assert abs(r["autocorrelation"] - sum(a * b for a, b in zip(d, d[1:])) / sum(a * a for a in d)) < 1e-5


def test_terms_are_of_all_events(spark):
    e = table(spark, SF, "events").filter("event_type = 'click'")
    want = {r[0]: r[1] for r in e.groupBy(F.col("user_id") % 2).agg(F.avg("value")).collect()}
    got = {r["term"]: r["coef"] for r in core.queries()["posterior_summary"](spark, SF).collect()}
    assert abs(got[0] - (want[0] - want[1]) / 100) < 1e-5


def test_steps_of_one_group_are_no_tests(spark):
    rows = [(u, t, "ab"[u % 2], (u + t) % 3 % 2) for u in range(8) for t in range(4 if u % 2 else 6)]
    panel = spark.createDataFrame(rows, "subject int, t int, grp string, y int")
    got = {r["t"]: r for r in inference.timepoint_p(panel).collect()}
    cut = {r["t"]: r["q"] for r in inference.timepoint_p(panel.filter("t < 4")).collect()}
    assert {t: r["q"] for t, r in got.items()} == {**cut, 4: None, 5: None}


def test_vectors_are_whole(spark):
    e = {r["vec_id"]: (r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()}
    sets = {i: frozenset(f for f, x in enumerate(v) if x > 0.1) for i, (_, v) in e.items()}
    sets = {i: s for i, s in sets.items() if s}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    got = {r["pattern_id"]: r["cluster"] for r in core.queries()["pattern_clusters"](spark, SF).collect()}
    assert set(got) == set(sets)
    if not near:
        assert all(got[i] == i for i in got)
    labels = sorted({label for label, _ in e.values()})
    ranks = {}
    for label in labels:
        own = np.array([v for k, v in e.values() if k == label], float).mean(0)
        ranks[label] = own.argsort().argsort()
    assert len(ranks[labels[0]]) == 64
    for r in core.queries()["rank_correlation_p"](spark, SF).collect():
        rho = np.corrcoef(ranks[r["a"]], ranks[r["b"]])[0, 1]
        z = abs(rho) * (62 / (1 - rho**2)) ** 0.5
        assert abs(r["rho"] - rho) < 1e-5
        want = spark.range(1).select(t_two_sided(F.lit(z), F.lit(62)).alias("p")).first()["p"] if r["a"] == labels[0] else r["p_value"]
        assert abs(r["p_value"] - want) < 1e-5
