"""Every registered query with a DuckDB form against it, and properties of the rest."""

import math

import pytest
from pyspark.sql import functions as F

from compare import connect, same
from statewise.functions.special import normal_cdf
from statewise.functions.tails import chi2_tail, correlation_p, t_two_sided
from statewise.operators import align, curves, inference, pairs, reports, sequences
from statewise.plans import queries as core
from statewise.plans.views import v_seq
from statewise.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, con, name):
    same(core.queries()[name](spark, SF), con, core.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_normal_cdf(spark):
    z = [-9.0, -6.5, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 2.5, 5.9, 6.1, 12.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-10


def test_snap_rule(spark):
    points = spark.createDataFrame([(10,), (5,), (7,), (15,), (20,), (14,)], "bin int")
    edges = spark.createDataFrame([(7,), (11,), (15,)], "boundary int")
    got = {r["bin"]: r["snapped"] for r in align.boundary_snap(points, edges, 3).collect()}
    assert got == {10: 7, 5: None, 7: None, 15: 15, 20: None, 14: 11}


def test_posterior_golden(spark):
    terms = spark.createDataFrame([("x", 0.142, 0.057), ("y", -0.139, 0.063), ("z", 1.009, 0.093)], "term string, coef double, sd double")
    got = {r["term"]: r for r in inference.posterior_summary(terms, capped=True).collect()}
    assert abs(got["x"]["prob_positive"] - 0.994) < 1e-3 and abs(got["x"]["bayes_factor"] - 23.59) < 2.5 and abs(got["x"]["odds_ratio"] - 1.153) < 1e-3
    assert got["x"]["evidence"] == "Strong" and abs(got["y"]["prob_positive"] - 0.014) < 1e-3
    assert got["z"]["bayes_factor"] == 1000.0


def test_fdr_golden(spark):
    terms = spark.createDataFrame([(i, p) for i, p in enumerate([0.986, 0.936, 0.885, 0.822, 0.784])], "term int, prob_direction double")
    got = [(round(r["fdr"], 3), r["credible"]) for r in inference.bayes_fdr(terms).orderBy("term").collect()]
    assert got == [(0.014, True), (0.039, True), (0.064, False), (0.093, False), (0.117, False)]


def test_sequence_properties(spark):
    seq = v_seq(spark, SF)
    assert seq.count() == sequences.state_runs(seq).agg(F.sum("length")).first()[0]
    assert all(abs(r[0] - 1) < 1e-9 for r in sequences.occupancy(seq, 5).groupBy("subject").agg(F.sum("occupancy")).select("sum(occupancy)").collect())


def test_single_state_and_empty(spark):
    one = spark.createDataFrame([(1, t, 2, "a", 1.0) for t in range(6)], "subject long, t int, state int, grp string, x double")
    assert [tuple(r) for r in sequences.state_runs(one).collect()] == [(1, 1, 2, 0, 6, 9.0)]
    assert sequences.zscore(one).filter("z is not null").count() == 0
    assert sequences.state_runs(one.filter("t < 0")).count() == 0


def test_t_tail(spark):
    """Against the closed forms for 1, 2 and 4 degrees of freedom and the normal limit."""
    closed = {
        1: lambda t: 1 - 2 / math.pi * math.atan(t),
        2: lambda t: 1 - t / math.sqrt(2 + t * t),
        4: lambda t: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)),
    }
    rows = [(t, n) for t in (0.0, 0.01, 0.5, 1.0, 2.5, 12.0) for n in closed] + [(1.5, 10**7), (None, 3), (float("nan"), 3), (1.0, 0)]
    for r in spark.createDataFrame(rows, "t double, n long").select("t", "n", t_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        if r["n"] in closed:
            assert abs(r["p"] - closed[r["n"]](r["t"])) < 1e-10
        elif r["n"] > 100:
            assert abs(r["p"] - math.erfc(r["t"] / math.sqrt(2))) < 1e-6
        else:
            assert r["p"] is None


def test_chi2_tail(spark):
    def closed(x, n):
        if n % 2 == 0:
            return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(n // 2))
        return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (n + 1) // 2))

    rows = [(x, n) for x in (0.0, 0.3, 2.0, 9.5, 11.5, 60.0) for n in (1, 2, 5, 10, 21)]
    for r in spark.createDataFrame(rows, "x double, n long").select("x", "n", chi2_tail(F.col("x"), F.col("n")).alias("p")).collect():
        assert abs(r["p"] - closed(r["x"], r["n"])) < 1e-10


def test_correlation_p(spark):
    rows = [(1.0, 8), (-1.0, 8), (0.0, 8), (0.5, 2), (None, 8), (math.sqrt(0.5), 4)]
    got = [r["p"] for r in spark.createDataFrame(rows, "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:2] == [0.0, 0.0] and abs(got[2] - 1) < 1e-12 and got[3:5] == [None, None]
    assert abs(got[5] - (1 - math.sqrt(0.5))) < 1e-9  # t = sqrt(2) with 2 degrees of freedom


def test_ljung_box_p_is_the_tail_of_its_statistic(spark):
    for r in curves.ljung_box(v_seq(spark, SF)).filter("lag = 2").collect():
        assert abs(r["p_value"] - math.exp(-r["statistic"] / 2)) < 1e-9
    short = v_seq(spark, SF).filter("t < 20")
    assert curves.ljung_box(short).count() == 0


def test_knee(spark):
    curve = [("hyperbola", x / 10, 1 / (x / 10 + 0.1)) for x in range(0, 101)] + [("line", float(x), 100.0 - x) for x in range(20)] + [("flat", float(x), 1.0) for x in range(5)]
    got = {r["series"]: r["knee"] for r in curves.knee_point(spark.createDataFrame(curve, "series string, x double, y double")).collect()}
    # 1 / (x + c) scaled to the unit square bends most where its slope is -1
    assert set(got) == {"hyperbola"} and abs(got["hyperbola"] - 0.9) <= 0.15


def test_residuals_are_orthogonal(spark):
    left = curves.residualise(v_seq(spark, SF), ["t", "state"])
    for r in left.groupBy("subject").agg(F.sum("residual").alias("a"), F.sum(F.col("residual") * F.col("t")).alias("b"), F.sum(F.col("residual") * F.col("state")).alias("c"), F.stddev_samp("z").alias("s")).collect():
        assert max(abs(r["a"]), abs(r["b"]), abs(r["c"])) < 1e-5 and abs(r["s"] - 1) < 1e-9
    constant = spark.createDataFrame([(1, t, 2.0, 5.0) for t in range(5)], "subject long, t long, x double, c double")
    assert [(abs(r["residual"]) < 1e-9, r["z"]) for r in curves.residualise(constant, ["c"]).collect()] == [(True, None)] * 5


def test_line_pairs(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("one\n1\ntwo\n2\n")
    got = sorted((r["record"], r["first"], r["second"]) for r in tables.read_line_pairs(spark, str(tmp_path)).collect())
    assert got == [(0, "one", "1"), (1, "two", "2")]


def test_encoding_is_probed(spark, tmp_path):
    line = "onset,text\n0.5,caf\u00e9\n1.0,\n"
    for name, encoding, found in (("new", "utf-8", "UTF-8"), ("old", "latin-1", "ISO-8859-1")):
        (tmp_path / f"{name}.csv").write_bytes(line.encode(encoding))
        assert tables.probe_encoding(spark, str(tmp_path / f"{name}.csv")) == found
        got = tables.read_csv_probed(spark, str(tmp_path / f"{name}.csv"), "onset double, text string").collect()
        assert [(r["onset"], r["text"]) for r in got] == [(0.5, "caf\u00e9"), (1.0, None)]


@pytest.mark.parametrize("coding", ["deviation", "treatment"])
def test_group_posteriors(spark, coding):
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    main = spark.createDataFrame([("x", 0.2, 0.1)], "term string, coef double, sd double")
    both = spark.createDataFrame([("x", -0.1, 0.05)], "term string, coef double, sd double")
    r = reports.group_posteriors(main, both, coding).first()
    joint = math.sqrt(0.1**2 + 0.05**2)
    want = {"a": (0.1, joint), "b": (0.3, joint)} if coding == "deviation" else {"a": (0.2, 0.1), "b": (0.1, joint)}
    for g, (coef, sd) in want.items():
        assert abs(r[f"coef_{g}"] - coef) < 1e-12 and abs(r[f"sd_{g}"] - sd) < 1e-12
        assert abs(r[f"prob_positive_{g}"] - phi(coef / sd)) < 1e-9 and abs(r[f"or_lower_{g}"] - math.exp(coef - 1.959963984540054 * sd)) < 1e-9
    assert abs(r["prob_stronger"] - phi(-2.0)) < 1e-9


def test_fold_table_puts_missing_ratios_last(spark):
    loo = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 2.0), ("x", "b", 1.0), ("x", "b", 3.0), ("w", "a", 1.0)], "term string, grp string, coef double")
    assert [(r["term"], r["place"]) for r in reports.fold_table(loo).orderBy("place").collect()] == [("x", 1), ("w", 2)]


def test_correlations_without_variance_are_null(spark):
    seq = spark.createDataFrame([(u, t, 1 if u == 1 else t % 2, 0.5) for u in (1, 2, 3) for t in range(6)], "subject int, t int, state int, x double")
    got = {(r["a"], r["b"]): r["code_corr"] for r in pairs.pair_overlap(seq).collect()}
    assert got[1, 2] is None and got[1, 3] is None and abs(got[2, 3] - 1) < 1e-9
    assert {r["coupling"] for r in pairs.pair_coupling(seq).collect()} == {None}
