"""Registered queries over the views, each with its DuckDB form; doubles are rounded alike on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.special import bin_floor, bin_half_even
from ..models import diagnostics, glmm, grid, hmm, linear
from ..operators import align, clustering, curves, hierarchy, inference, pairs, panel, patterns, reports
from ..operators import sequences as q
from ..sources import tables
from ..sources.shared import numbered, scanned, shared_dir, staged
from .views import BIN, K, MODELS, OBS, RT, SEQ, SIGNAL, WIDTH, WORD, table, v_atlas, v_models, v_obs, v_rt, v_seg, v_seq, v_signal, v_word

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _round6(c: str) -> Column:
    """F.round(c, 6), which goes by decimal digits: by arithmetic wherever the seventh place is clear of a half."""
    size = F.abs(F.col(c) * 1e6)
    whole = F.floor(size + 0.5)
    clear = (size < 1e12) & (F.abs(size - F.floor(size) - 0.5) > 1e-3)
    return F.when(clear, F.when(F.col(c) < 0, -whole).otherwise(whole) / F.lit(1e6)).otherwise(F.round(c, 6))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, whole numbers as long."""
    kinds = dict(df.dtypes)
    return df.select(*[(_round6(c) if kinds[c] == "double" else F.round(c, 6)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns])


def _query(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf: _rounded(f(spark, sf))
        if sql:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# sequences
_query("state_runs", f"WITH {SEQ} SELECT subject, run::BIGINT AS run, state::BIGINT AS state, start, length, duration FROM runs")(lambda s, d: q.state_runs(v_seq(s, d)))
_query("occupancy", f"WITH {SEQ} SELECT s.subject, st.state, round(count(*) FILTER (s.state = st.state) / count(*)::DOUBLE, 6) AS occupancy FROM seq s, st GROUP BY 1, 2")(lambda s, d: q.occupancy(v_seq(s, d), K))
_query(
    "duration_stats",
    f"""WITH {SEQ},
u AS (SELECT DISTINCT subject FROM seq)
SELECT u.subject, st.state, round(coalesce(avg(duration), 0), 6) AS mean_duration, round(coalesce(stddev_pop(duration), 0), 6) AS std_duration,
  round(coalesce(quantile_cont(duration, 0.5), 0), 6) AS median_duration, coalesce(max(duration), 0) AS max_duration, coalesce(min(duration), 0) AS
  min_duration, count(duration) AS n_runs FROM u CROSS JOIN st LEFT JOIN runs r ON r.subject = u.subject AND r.state = st.state GROUP BY 1, 2""",
)(lambda s, d: q.duration_stats(v_seq(s, d), K))
_query("group_durations", f"""WITH {SEQ} SELECT state::BIGINT AS state, round(avg(duration), 6) AS mean_duration, round(stddev_pop(duration), 6) AS std_duration,
  round(quantile_cont(duration, 0.5), 6) AS median_duration, count(*) AS n_runs FROM runs GROUP BY 1""")(lambda s, d: q.group_durations(v_seq(s, d)))
_TM = f"""{SEQ},
tc AS (SELECT subject, prev AS a, state AS b, count(*) AS n FROM chg WHERE prev <> state GROUP BY 1, 2, 3),
tp AS (SELECT a, b, n / sum(n) OVER (PARTITION BY subject, a) AS p FROM tc),
tm AS (SELECT x.state AS from_state, y.state AS to_state, coalesce(sum(p), 0) / (SELECT count(DISTINCT subject) FROM seq) AS probability FROM st x
  CROSS JOIN st y LEFT JOIN tp ON a = x.state AND b = y.state GROUP BY 1, 2)"""
_query("transition_matrix", f"WITH {_TM} SELECT from_state, to_state, round(probability, 6) AS probability FROM tm")(lambda s, d: q.transition_matrix(v_seq(s, d), K))
_query("transition_entropy", f"""WITH {_TM},
n AS (SELECT from_state, probability / sum(probability) OVER (PARTITION BY from_state) AS p FROM tm)
SELECT from_state, round(coalesce(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 0), 6) AS entropy FROM n GROUP BY 1""")(lambda s, d: q.transition_entropy(v_seq(s, d), K))
_query("switching_rate", f"""WITH {SEQ} SELECT count(*) FILTER (prev <> state) AS n_changes, round(count(*) FILTER (prev <> state) / (count(*) * 1.5::DOUBLE), 6) AS per_second,
  round(count(*) FILTER (prev <> state) / count(prev)::DOUBLE, 6) AS per_step FROM chg""")(lambda s, d: q.switching_rate(v_seq(s, d)))
_query(
    "usage_metrics",
    f"""WITH {SEQ},
p AS (SELECT st.state, count(s.t) / sum(count(s.t)) OVER ()::DOUBLE AS p FROM st LEFT JOIN seq s USING (state) GROUP BY 1),
h AS (SELECT t, -sum(p * ln(p)) AS h FROM (SELECT t, count(*) / sum(count(*)) OVER (PARTITION BY t)::DOUBLE AS p FROM seq GROUP BY t, state) GROUP BY
  t)
SELECT (SELECT round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) FROM p) AS state_entropy, (SELECT round(1 - stddev_pop(p) / avg(p), 6) FROM
  p) AS usage_balance, (SELECT round(1 - avg(h) / ln(5), 6) FROM h) AS temporal_consistency""",
)(lambda s, d: q.usage_metrics(v_seq(s, d), K))
_BR = f"""{SEQ},
yb AS (SELECT subject, grp, t, (state = 1)::INT AS y FROM seq),
yc AS (SELECT *, coalesce(y <> lag(y) OVER (PARTITION BY subject ORDER BY t), true)::INT AS c, y - lag(y) OVER (PARTITION BY subject ORDER BY t) AS dy
  FROM yb),
br AS (SELECT subject, any_value(grp) AS grp, run, any_value(y) AS y, min(t) AS start, count(*) AS length, count(*) * 1.5::DOUBLE AS duration FROM
  (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY t) AS run FROM yc) GROUP BY subject, run)"""
_query("binary_runs", f"WITH {_BR} SELECT subject, run::BIGINT AS run, y::BIGINT AS y, start, length, duration FROM br")(lambda s, d: q.binary_runs(v_seq(s, d), 1))
_query("entry_exit", f"WITH {_BR} SELECT grp, round(avg((dy = 1)::INT), 6) AS entry_rate, round(avg((dy = -1)::INT), 6) AS exit_rate FROM yc WHERE dy IS NOT NULL GROUP BY 1")(lambda s, d: q.entry_exit(v_seq(s, d), 1))
_query(
    "cluster_group_stats",
    f"""WITH {_BR},
o AS (SELECT grp, subject, avg(y) AS o FROM yb GROUP BY 1, 2),
a AS (SELECT grp, round(avg(o), 6) AS mean_occupancy, round(stddev_pop(o), 6) AS std_occupancy, count(*) AS n_subjects FROM o GROUP BY 1)
SELECT a.*, round(avg(length) FILTER (y = 1), 6) AS mean_run, round(stddev_pop(length) FILTER (y = 1), 6) AS std_run, round(avg(length) FILTER (y =
  0), 6) AS mean_interval, round(stddev_pop(length) FILTER (y = 0), 6) AS std_interval FROM a JOIN br USING (grp) GROUP BY ALL""",
)(lambda s, d: q.cluster_group_stats(v_seq(s, d), 1))
_query("state_mixing", f"WITH {SEQ} SELECT subject, t // 13 AS frame, round(count(DISTINCT state) / 5.0::DOUBLE, 6) AS mixing FROM seq GROUP BY 1, 2 HAVING count(*) = 13")(lambda s, d: q.state_mixing(v_seq(s, d), K))
_query(
    "sliding_entropy",
    f"""WITH {SEQ},
u AS (SELECT subject, count(*) AS n FROM seq GROUP BY 1),
c AS (SELECT a.subject, a.t, b.state, count(*) / 13.0::DOUBLE AS p FROM seq a JOIN u ON u.subject = a.subject JOIN seq b ON a.subject = b.subject AND
  b.t BETWEEN a.t AND a.t + 12 WHERE a.t < u.n - 13 GROUP BY 1, 2, 3),
h AS (SELECT subject, t, -sum(p * ln(p)) AS h FROM c GROUP BY 1, 2)
SELECT subject, round(avg(h), 6) AS mean_entropy, count(*) AS n_frames FROM h GROUP BY 1""",
)(lambda s, d: q.sliding_entropy(v_seq(s, d), K))
_query("recurrence", f"""WITH {SEQ},
g AS (SELECT state, (t - lag(t) OVER (PARTITION BY subject, state ORDER BY t)) * 1.5::DOUBLE AS gap FROM seq)
SELECT state::BIGINT AS state, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, count(gap) AS n_gaps FROM g WHERE gap
  IS NOT NULL GROUP BY 1""")(lambda s, d: q.recurrence(v_seq(s, d)))
_query("ar_lags", f"""WITH {SEQ},
y AS (SELECT subject, t, (state = 1)::BIGINT AS y FROM seq)
SELECT subject, t, y, lag(y, 1, 0) OVER w AS y_lag1, lag(y, 2, 0) OVER w AS y_lag2 FROM y WINDOW w AS (PARTITION BY subject ORDER BY t)""")(lambda s, d: q.ar_lags(panel.target_indicator(v_seq(s, d), 1).select("subject", "t", "y"), 2))
_query("zscore_series", f"WITH {SEQ} SELECT subject, t, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM seq WINDOW w AS (PARTITION BY subject)")(lambda s, d: q.zscore(v_seq(s, d)).select("subject", "t", "z"))
_query("detrend_series", f"""WITH {SEQ},
f AS (SELECT subject, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM seq GROUP BY 1)
SELECT subject, t, round(x - a - b * t, 5) AS residual FROM seq JOIN f USING (subject)""")(lambda s, d: q.detrend(v_seq(s, d)).select("subject", "t", F.round("residual", 5).alias("residual")))
_query("state_prob_t", f"WITH {SEQ} SELECT s.grp, s.t, st.state, round(count(*) FILTER (s.state = st.state) / count(*)::DOUBLE, 6) AS probability FROM seq s, st GROUP BY 1, 2, 3")(lambda s, d: q.state_probability(v_seq(s, d), K))
_query(
    "acf",
    f"""WITH {SEQ},
l AS (SELECT unnest(range(1, 11)) AS lag),
p AS (SELECT l.lag, a.subject, coalesce(corr(a.x, b.x), 0) AS r FROM l, seq a JOIN seq b ON a.subject = b.subject AND b.t = a.t - lag GROUP BY 1, 2)
SELECT lag, round(avg(r), 6) AS acf FROM p GROUP BY 1""",
)(lambda s, d: q.acf(v_seq(s, d)))
_TC = f"{SEQ}, tc AS (SELECT grp, t, avg((state = 1)::INT) AS mean, stddev_samp((state = 1)::INT) / sqrt(count(*)) AS sem, count(*) AS n FROM seq GROUP BY 1, 2)"
_query("group_timecourse", f"WITH {_TC} SELECT grp, t, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM tc")(lambda s, d: panel.group_timecourse(panel.target_indicator(v_seq(s, d), 1)))
_query(
    "gauss_smooth",
    f"""WITH {_TC},
mx AS (SELECT grp, max(t) AS m FROM tc GROUP BY 1),
o AS (SELECT tc.grp, t, m, unnest(range(-8, 9)) AS o FROM tc JOIN mx ON mx.grp = tc.grp),
a AS (SELECT grp, t, exp(-0.5 * (o / 2.0) ** 2) AS w, CASE WHEN t + o < 0 THEN -1 - t - o WHEN t + o > m THEN 2 * m + 1 - t - o ELSE t + o END AS at
  FROM o)
SELECT a.grp, a.t, round(sum(w * mean) / sum(w), 6) AS smoothed FROM a JOIN tc ON tc.grp = a.grp AND tc.t = a.at GROUP BY 1, 2""",
)(lambda s, d: q.gauss_smooth(panel.group_timecourse(panel.target_indicator(v_seq(s, d), 1)), value="mean"))

# panels
_query("trim_rebase", f"WITH {SEQ} SELECT subject, t - 5 AS t, state::BIGINT AS state FROM seq WHERE t >= 5 AND t < 40")(lambda s, d: panel.trim_rebase(v_seq(s, d), 5, 40).select("subject", "t", "state"))
_query("bool_parse", "SELECT o_orderkey, (lower(CAST(o_orderstatus = 'F' AS VARCHAR)) = 'true')::BIGINT AS flag FROM orders")(lambda s, d: panel.bool_parse(table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("flag")), "flag"))
_query("target_indicator", f"WITH {SEQ} SELECT subject, t, (state = 2)::BIGINT AS y FROM seq")(lambda s, d: panel.target_indicator(v_seq(s, d), 2).select("subject", "t", "y"))
_query("state_relabel", f"WITH {SEQ} SELECT subject, t, (CASE state WHEN 0 THEN 4 WHEN 4 THEN 0 ELSE state END)::BIGINT AS state FROM seq")(lambda s, d: panel.state_relabel(v_seq(s, d), {0: 4, 4: 0}).select("subject", "t", "state"))
_query("stratified_sample", f"""WITH {SEQ},
u AS (SELECT DISTINCT subject, grp FROM seq),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(subject::VARCHAR || ':7'), subject) AS place FROM u)
SELECT * FROM r WHERE place <= CASE grp WHEN 'a' THEN 5 ELSE 6 END""")(lambda s, d: panel.stratified_sample(v_seq(s, d), {"a": 5, "b": 6}, 7))
_query("densify_binary", f"""WITH {RT},
k AS (SELECT DISTINCT participant FROM resp),
m AS (SELECT DISTINCT participant, greatest(0, least(bin, 119)) AS bin FROM resp)
SELECT k.participant, b.bin, (m.bin IS NOT NULL)::BIGINT AS y FROM k CROSS JOIN (SELECT unnest(range(120)) AS bin) b LEFT JOIN m ON m.participant =
  k.participant AND m.bin = b.bin""")(
    lambda s, d: panel.densify_binary(r := align.response_bins(v_rt(s, d), BIN), r, 120)
)
_query("panel_checks", f"""WITH {SEQ},
p AS (SELECT subject, count(*) AS n, count(*) FILTER (isnan(x) OR x IS NULL OR isinf(x)) AS bx, count(*) FILTER (state IS NULL OR state NOT IN (0,1,2)) AS bs, count(*)
  FILTER (state NOT IN (0, 1)) + count(*) FILTER (t % 3 = 2) AS bf FROM seq GROUP BY 1)
SELECT count(*) AS n_subjects, max(n) - min(n) AS length_gap, sum(bx)::BIGINT AS not_finite, sum(bs)::BIGINT AS bad_labels, sum(bf)::BIGINT AS
  not_binary FROM p""")(
    lambda s, d: panel.panel_checks(v_seq(s, d).withColumns({"f": F.col("state"), "g": F.col("t") % 3}), [0, 1, 2], ["f", "g"])
)
_query("target_series", f"WITH {SEQ} SELECT 'sub-' || subject AS subject, grp, t, (state = 1)::BIGINT AS y, round(avg((state = 1)::INT) OVER (PARTITION BY subject), 6) AS mean_occupancy FROM seq")(lambda s, d: panel.target_series(v_seq(s, d), 1))
_query("participant_sets", """WITH a AS (SELECT DISTINCT user_id AS participant FROM events WHERE event_type = 'error'),
b AS (SELECT DISTINCT user_id AS participant FROM events WHERE value > 100)
SELECT coalesce(a.participant, b.participant) AS participant, a.participant IS NOT NULL AND b.participant IS NOT NULL AS in_both FROM a FULL JOIN b
  USING (participant)""")(
    lambda s, d: panel.participant_sets(v_rt(s, d), table(s, d, "events").filter("value > 100").select(F.col("user_id").alias("participant")))
)
_query("loo_folds", f"""WITH {SEQ},
u AS (SELECT subject, avg(x) AS m FROM seq GROUP BY 1)
SELECT b.subject AS held_out, round(avg(a.m), 6) AS mean, count(*) AS n FROM u a JOIN u b ON a.subject <> b.subject GROUP BY 1""")(
    lambda s, d: panel.leave_one_out(v_seq(s, d).groupBy("subject").agg(F.avg("x").alias("m")), "m").select("held_out", "mean", "n")
)
_query(
    "design_matrix",
    f"""WITH {SEQ},
f AS (SELECT t, (avg((state = 2)::INT) > 0.2)::BIGINT AS f FROM seq GROUP BY 1),
y AS (SELECT subject, grp, t, (state = 1)::BIGINT AS y FROM seq)
SELECT subject, grp, t, y, lag(y, 1, 0) OVER w AS y_lag1, lag(y, 2, 0) OVER w AS y_lag2, CASE grp WHEN 'a' THEN 1 ELSE -1 END::BIGINT AS group_coded,
  f, (CASE grp WHEN 'a' THEN 1 ELSE -1 END * f)::BIGINT AS group_f_interaction FROM y JOIN f USING (t) WINDOW w AS (PARTITION BY subject ORDER BY t)""",
)(lambda s, d: panel.design_matrix(panel.target_indicator(x := v_seq(s, d), 1).select("subject", "grp", "t", "y"), x.groupBy("t").agg((F.avg((F.col("state") == 2).cast("int")) > 0.2).cast("long").alias("f")), ["f"]))

# alignment
_query("bin_round", f"WITH {RT} SELECT participant, round_even(rt / 21600, 0)::BIGINT AS bin, count(*) AS n FROM rt GROUP BY 1, 2")(lambda s, d: v_rt(s, d).groupBy("participant", bin_half_even(F.col("rt"), BIN).alias("bin")).agg(F.count("*").alias("n")))
_query("semi_join_participants", f"WITH {RT} SELECT participant, count(*) AS n FROM rt WHERE participant IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")(
    lambda s, d: align.semi_join(v_rt(s, d), table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("participant"))).groupBy("participant").agg(F.count("*").alias("n"))
)
_AG = f"{RT}, ag AS (SELECT bin, count(DISTINCT participant) AS count, count(DISTINCT participant) / (SELECT count(DISTINCT participant) FROM resp)::DOUBLE AS agreement FROM resp GROUP BY 1)"


def _agreement(s: SparkSession, d: str) -> DataFrame:
    return align.agreement(align.response_bins(v_rt(s, d), BIN))


_query("agreement", f"WITH {_AG} SELECT bin::BIGINT AS bin, count, round(agreement, 6) AS agreement FROM ag")(_agreement)
_SNAP = f"""{_AG},
e AS (SELECT bin AS boundary FROM (SELECT bin, count > 1.1::DOUBLE * lag(count) OVER (ORDER BY bin) AS rises FROM ag) WHERE rises),
sn AS (SELECT ag.*, CASE WHEN bin > (SELECT min(boundary) FROM e) AND bin <= (SELECT max(boundary) FROM e) AND bin - (SELECT max(boundary) FROM e
  WHERE boundary <= bin) <= 3 THEN (SELECT max(boundary) FROM e WHERE boundary <= bin) END AS snapped FROM ag)"""


def _snapped(s: SparkSession, d: str) -> DataFrame:
    """Bins snapped to the bins where the count rises by more than a tenth."""
    a = _agreement(s, d)
    rises = scanned(a, {"before": ("previous", F.col("count"))}, F.col("bin")).filter(F.col("count") > F.lit(1.1) * F.col("before"))
    return align.boundary_snap(a, rises.select(F.col("bin").alias("boundary")), 3)


_query("boundary_snap", f"WITH {_SNAP} SELECT bin::BIGINT AS bin, count, round(agreement, 6) AS agreement, snapped::BIGINT AS snapped FROM sn")(_snapped)
_query("agreement_snapped", f"WITH {_SNAP} SELECT snapped::BIGINT AS snapped, sum(count)::BIGINT AS count, round(sum(count) / (SELECT count(DISTINCT participant) FROM resp)::DOUBLE, 6) AS agreement FROM sn WHERE snapped IS NOT NULL GROUP BY 1")(lambda s, d: align.agreement_snapped(_snapped(s, d), align.response_bins(v_rt(s, d), BIN)))
_PK = f"""{_AG}, ix AS (SELECT bin, round(agreement, 9) AS v, row_number() OVER (ORDER BY bin) - 1 AS i FROM ag), rn AS (SELECT *, sum(ch) OVER (ORDER BY i) AS run FROM (SELECT *, coalesce(v <> lag(v) OVER (ORDER BY i), true)::INT AS ch FROM ix)),
fl AS (SELECT run, any_value(v) AS v, min(i) AS i0, max(i) AS i1 FROM rn GROUP BY 1), tp AS (SELECT * FROM (SELECT *, lag(v) OVER (ORDER BY run) AS l, lead(v) OVER (ORDER BY run) AS n FROM fl) WHERE v > l AND v > n),
pk AS (SELECT ix.bin, tp.v AS agreement, tp.v - greatest((SELECT min(v) FROM fl WHERE fl.run < tp.run AND fl.run > coalesce((SELECT max(h.run) FROM fl h WHERE h.run < tp.run AND h.v > tp.v), 0)), (SELECT min(v) FROM fl WHERE fl.run > tp.run AND fl.run < coalesce((SELECT min(h.run) FROM fl h WHERE h.run > tp.run AND h.v > tp.v), 1000000))) AS prominence FROM tp JOIN ix ON ix.i = (tp.i0 + tp.i1) // 2)"""


def _series(s: SparkSession, d: str) -> DataFrame:
    return _agreement(s, d).withColumn("agreement", F.round("agreement", 9))


_query("peaks_prominence", f"WITH {_PK} SELECT bin::BIGINT AS bin, round(agreement, 6) AS agreement, round(prominence, 6) AS prominence FROM pk")(lambda s, d: align.peaks(_series(s, d)))
_query("threshold_sweep", f"""WITH {_PK},
g AS (SELECT round((round(quantile_cont(agreement, 0.85), 2) - 0.05) / 0.01)::INT AS lo, round(round(quantile_cont(agreement, 0.95), 2) / 0.01)::INT
  AS hi FROM (SELECT round(agreement, 9) AS agreement FROM ag)),
k AS (SELECT round(unnest(range(lo, hi + 1)) * 0.01::DOUBLE, 2) AS threshold FROM g)
SELECT threshold, (SELECT count(*) FROM pk WHERE prominence >= threshold) AS n_peaks FROM k""")(
    lambda s, d: align.threshold_sweep(align.peaks(x := _series(s, d)), x)
)


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return align.word_flags(align.asof_segment(v_word(s, d), v_seg(s, d)), "user", {"verb": "verb", "noun": "noun"})


_AS = f"""{WORD},
asw AS (SELECT w.*, g.seg, g.speaker, g.onset_sec, g.speaker IS NOT NULL AS is_dialog, coalesce(contains(lower(g.speaker), 'user'), false) AS
  user_speaking, w.pos = 'verb' AS is_verb, w.pos = 'noun' AS is_noun FROM w ASOF JOIN seg g ON g.story = w.story AND w.onset >= g.onset_sec)"""
_query("asof_segment", f"WITH {_AS} SELECT story, word_id, round(onset, 6) AS onset, speaker, round(onset_sec, 6) AS onset_sec FROM asw")(lambda s, d: _tagged(s, d).select("story", "word_id", "onset", "speaker", "onset_sec"))
_query("word_flags", f"WITH {_AS} SELECT story, word_id, is_dialog, user_speaking, is_verb, is_noun FROM asw")(lambda s, d: _tagged(s, d).select("story", "word_id", "is_dialog", "user_speaking", "is_verb", "is_noun"))
_query(
    "bin_majority",
    f"""WITH {_AS},
b AS (SELECT *, floor((onset - min(onset) OVER (PARTITION BY story)) / 6)::BIGINT AS bin FROM asw),
m AS (SELECT story, bin, speaker, count(*) AS n, row_number() OVER (PARTITION BY story, bin ORDER BY count(*) DESC, speaker) AS r FROM b GROUP BY 1,
  2, 3)
SELECT b.story, b.bin, avg(is_verb::INT) > 0.5 AS mostly_is_verb, max(is_verb) AS has_is_verb, sum(is_verb::INT)::BIGINT AS n_is_verb,
  string_agg(text, ' ' ORDER BY onset, word_id) AS words, arg_min(seg, word_id) AS segment_text, any_value(m.speaker) AS speaker FROM b JOIN m ON
  m.story = b.story AND m.bin = b.bin AND r = 1 GROUP BY 1, 2""",
)(lambda s, d: align.bin_majority(_tagged(s, d), ["is_verb"], 6.0))
_WIN = f"{WORD}, wi AS (SELECT story, coalesce(lag(onset_sec) OVER (PARTITION BY story ORDER BY onset_sec), 0) AS begin, onset_sec AS stop FROM seg WHERE onset_sec > 0)"


def _windows(s: SparkSession, d: str) -> DataFrame:
    return align.windows_between(v_seg(s, d).filter("onset_sec > 0").select("story", F.col("onset_sec").alias("boundary")), "story")


_query("events_to_text", f"""WITH {_WIN} SELECT wi.story, round(begin, 6) AS begin, round(stop, 6) AS "end", string_agg(text, ' ' ORDER BY onset, word_id) AS text FROM wi JOIN w
  ON w.story = wi.story AND onset >= begin AND onset <= stop GROUP BY 1, 2, 3""")(lambda s, d: align.events_to_text(v_word(s, d), _windows(s, d)))
_query(
    "events_to_segments",
    f"""WITH {_WIN},
nu AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY onset_sec, seg_id) AS i FROM seg),
ed AS (SELECT wi.story, begin, stop, max(i) FILTER (onset_sec <= begin) AS lo, max(i) FILTER (onset_sec < stop) AS hi FROM wi JOIN nu USING (story)
  GROUP BY 1, 2, 3)
SELECT ed.story, round(begin, 6) AS begin, round(stop, 6) AS "end", string_agg(seg, ' ' ORDER BY i) AS text, count(*) AS n_segments FROM ed JOIN nu ON
  nu.story = ed.story AND i >= lo AND i < hi GROUP BY 1, 2, 3""",
)(lambda s, d: align.events_to_segments(v_seg(s, d), _windows(s, d)))
_query("value_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")(lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n")))

# pairs
_AL = f"{SEQ}, al AS (SELECT x.subject AS a, y.subject AS b, x.t, x.state AS sa, y.state AS sb FROM seq x JOIN seq y ON x.t = y.t AND x.subject < y.subject)"
_MI = "sum(n / al_n * ln(n * al_n / (na * nb)))"
_query("pair_overlap", f"WITH {_AL} SELECT a, b, round(avg((sa = sb)::INT), 6) AS overlap, round(corr(sa, sb), 6) + 0.0 AS code_corr FROM al GROUP BY 1, 2")(lambda s, d: pairs.pair_overlap(v_seq(s, d)))
_query("pair_mi", f"""WITH {_AL},
c AS (SELECT a, b, sa, sb, count(*)::DOUBLE AS n FROM al GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS al_n, sum(n) OVER (PARTITION BY a, b, sa) AS na, sum(n) OVER (PARTITION BY a, b, sb) AS nb FROM c)
SELECT a, b, round({_MI}, 6) AS mutual_info FROM m GROUP BY 1, 2""")(lambda s, d: pairs.pair_mi(v_seq(s, d)))
_query("pair_coupling", f"""WITH {SEQ},
r AS (SELECT subject, length, row_number() OVER (PARTITION BY subject ORDER BY state, start) AS i FROM runs)
SELECT x.subject AS a, y.subject AS b, round(corr(x.length, y.length), 6) + 0.0 AS coupling, count(*) AS n_runs FROM r x JOIN r y ON x.i = y.i AND
  x.subject < y.subject GROUP BY 1, 2""")(lambda s, d: pairs.pair_coupling(v_seq(s, d)))
_query("temporal_mi", f"""WITH {SEQ},
c AS (SELECT x.t AS t1, y.t AS t2, x.state AS s1, y.state AS s2, count(*)::DOUBLE AS n FROM seq x JOIN seq y ON x.subject = y.subject AND x.t < y.t
  WHERE x.t % 10 = 0 AND y.t % 10 = 0 GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY t1, t2) AS al_n, sum(n) OVER (PARTITION BY t1, t2, s1) AS na, sum(n) OVER (PARTITION BY t1, t2, s2) AS nb
  FROM c)
SELECT t1, t2, round({_MI}, 6) AS mutual_info FROM m GROUP BY 1, 2""")(
    lambda s, d: pairs.temporal_mi(v_seq(s, d))
)
_query(
    "ari_nmi",
    f"""WITH {SEQ},
c AS (SELECT state AS a, (t // 9) AS b, count(*)::DOUBLE AS n FROM seq GROUP BY ALL),
ma AS (SELECT a, sum(n) AS n FROM c GROUP BY 1),
mb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
tot AS (SELECT sum(n) AS al FROM c),
v AS (SELECT (SELECT sum(c.n / al * ln(c.n * al / (ma.n * mb.n))) FROM c JOIN ma USING (a) JOIN mb USING (b), tot) AS mi, (SELECT -sum(n / al * ln(n /
  al)) FROM ma, tot) AS ha, (SELECT -sum(n / al * ln(n / al)) FROM mb, tot) AS hb, (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1)
  / 2) FROM ma) AS pa, (SELECT sum(n * (n - 1) / 2) FROM mb) AS pb, (SELECT al * (al - 1) / 2 FROM tot) AS pn)
SELECT round(mi, 6) AS mutual_info, round(mi / ((ha + hb) / 2), 6) AS nmi, round((pc - pa * pb / pn) / ((pa + pb) / 2 - pa * pb / pn), 6) AS ari FROM
  v""",
)(lambda s, d: pairs.label_agreement(v_seq(s, d).select("state", F.floor(F.col("t") / 9).alias("third")), "state", "third"))
_query("cosine_pairs", f"""WITH {OBS},
m AS (SELECT state, feature, avg(value) AS v FROM obs GROUP BY 1, 2)
SELECT x.state::BIGINT AS a, y.state::BIGINT AS b, round(sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v)) + 1e-12), 6) AS cosine FROM m x
  JOIN m y ON x.feature = y.feature AND x.state < y.state GROUP BY 1, 2""")(
    lambda s, d: pairs.cosine_pairs(v_obs(s, d).groupBy(F.col("state").alias("id"), "feature").agg(F.avg("value").alias("value")))
)
_SP = f"""{OBS},
m AS (SELECT state, feature, avg(value) AS v FROM obs GROUP BY 1, 2),
r AS (SELECT x.state, x.feature, count(*) FILTER (y.v < x.v) + (count(*) FILTER (y.v = x.v) + 1) / 2.0 AS r FROM m x JOIN m y ON x.state = y.state
  GROUP BY 1, 2),
sp AS (SELECT x.state::BIGINT AS a, y.state::BIGINT AS b, corr(x.r, y.r) AS rho, count(*) - 2 AS df FROM r x JOIN r y ON x.feature = y.feature AND x.state < y.state GROUP BY 1, 2)"""
_query("spearman_pairs", f"WITH {_SP} SELECT a, b, round(rho, 6) AS rho FROM sp")(
    lambda s, d: pairs.spearman_pairs(v_obs(s, d).groupBy(F.col("state").alias("id"), "feature").agg(F.avg("value").alias("value")))
)
_PT = f"{OBS}, p AS (SELECT id AS pattern_id, feature FROM obs WHERE value > 0.1)"


def _patterns(s: SparkSession, d: str, view: Query = v_obs) -> DataFrame:
    return view(s, d).filter("value > 0.1").select(F.col("id").alias("pattern_id"), "feature")


_JC = f"""{_PT},
z AS (SELECT pattern_id, count(*) AS n FROM p GROUP BY 1),
j AS (SELECT x.pattern_id AS a, y.pattern_id AS b, count(*) AS shared FROM p x JOIN p y ON x.feature = y.feature AND x.pattern_id < y.pattern_id GROUP
  BY 1, 2),
jc AS (SELECT a, b, shared, shared / (za.n + zb.n - shared)::DOUBLE AS jaccard FROM j JOIN z za ON za.pattern_id = a JOIN z zb ON zb.pattern_id = b)"""
_query("jaccard_pairs", f"WITH {_JC} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM jc")(lambda s, d: pairs.jaccard_pairs(_patterns(s, d)))
_query(
    "separation_ratio",
    f"""WITH {OBS},
r AS (SELECT id, state, feature, rank() OVER (PARTITION BY id ORDER BY value) + (count(*) OVER (PARTITION BY id, value) - 1) / 2.0::DOUBLE AS r FROM
  obs),
c AS (SELECT x.state = y.state AS own, corr(x.r, y.r) AS rho FROM r x JOIN r y ON x.feature = y.feature AND x.id < y.id GROUP BY x.id, y.id, x.state,
  y.state),
m AS (SELECT avg(1 - rho) FILTER (own) AS w, avg(1 - rho) FILTER (NOT own) AS b FROM c)
SELECT round(w, 6) AS within, round(b, 6) AS "between", round(b / w, 6) AS ratio, round(1 - w, 6) AS within_correlation FROM m""",
)(lambda s, d: pairs.rank_separation(o := v_obs(s, d), o.select("id", F.col("state").alias("cluster")).distinct()))
_query(
    "jaccard_separation",
    f"""WITH {_JC},
l AS (SELECT vec_id, label FROM embeddings),
n AS (SELECT x.label = y.label AS own, count(*) AS n FROM l x JOIN l y ON x.vec_id < y.vec_id GROUP BY 1),
k AS (SELECT x.label = y.label AS own, sum(jaccard) AS j FROM jc JOIN l x ON x.vec_id = a JOIN l y ON y.vec_id = jc.b GROUP BY 1),
r AS (SELECT max(1 - coalesce(j, 0) / n) FILTER (own) AS w, max(1 - coalesce(j, 0) / n) FILTER (NOT own) AS b FROM n LEFT JOIN k USING (own))
SELECT round(w, 6) AS within, round(b, 6) AS "between", round(b / w, 6) AS ratio FROM r""",
)(lambda s, d: pairs.jaccard_separation(_patterns(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("pattern_id"), F.col("label").alias("cluster"))))
_GD = f"{SEQ}, m AS (SELECT t, avg((state = 1)::INT) FILTER (grp = 'a') AS x, avg((state = 1)::INT) FILTER (grp = 'b') AS z FROM seq GROUP BY 1)"
_query("group_distance", f"""WITH {_GD} SELECT round(sqrt(sum((x - z) ** 2)), 6) AS euclidean, round(avg(abs(x - z)), 6) AS mean_abs, round(1 - corr(x, z), 6) AS one_minus_corr
  FROM m WHERE x IS NOT NULL AND z IS NOT NULL""")(lambda s, d: pairs.group_distance(panel.target_indicator(v_seq(s, d), 1)))

# patterns
_SF = f"""{OBS},
sf AS (SELECT state::BIGINT AS state, feature, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM obs GROUP BY 1, 2),
si AS (SELECT *, coalesce(std / nullif(abs(mean), 0), 0) AS cv, abs(mean) * std AS importance FROM sf)"""
_query("state_feature_stats", f"WITH {_SF} SELECT state, feature, round(mean, 6) AS mean, round(std, 6) AS std, n, round(cv, 4) AS cv, round(importance, 6) AS importance FROM si")(lambda s, d: patterns.state_feature_stats(v_obs(s, d)).withColumn("cv", F.round("cv", 4)))
_query("topk_features", f"WITH {_SF} SELECT state, feature, place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY importance DESC, feature) AS place FROM si) WHERE place <= 3")(lambda s, d: patterns.top_features(patterns.state_feature_stats(v_obs(s, d)), 3).select("state", "feature", "place"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("label").alias("state"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(WIDTH)])


_CV = """w AS (SELECT label::BIGINT AS state, unnest(range(len(embedding))) AS i, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings),
cv AS (SELECT x.state, 'f' || x.i AS f1, 'f' || y.i AS f2, covar_pop(x.v, y.v) AS cov, corr(x.v, y.v) AS corr FROM w x JOIN w y ON x.vec_id = y.vec_id
  AND x.i <= y.i GROUP BY 1, 2, 3)"""
_query("state_corr", f"WITH {_CV} SELECT state, f1, f2, round(cov, 6) AS cov, round(greatest(-1, least(1, corr)), 6) AS corr FROM cv")(lambda s, d: patterns.state_covariance(_wide(s, d), [f"f{i}" for i in range(WIDTH)]))
_query("effective_dim", f"WITH {_CV} SELECT state, round(sum(cov) FILTER (f1 = f2) ** 2 / (sum(CASE WHEN f1 = f2 THEN cov ** 2 ELSE 2 * cov ** 2 END) + 1e-12), 5) AS effective_dim FROM cv GROUP BY 1")(lambda s, d: patterns.effective_dimension(patterns.state_covariance(_wide(s, d), [f"f{i}" for i in range(WIDTH)])).withColumn("effective_dim", F.round("effective_dim", 5)))


def _intervals(s: SparkSession, d: str) -> DataFrame:
    half = 1.96 * F.col("std") / F.sqrt("n")
    return patterns.state_feature_stats(v_obs(s, d)).select(F.col("state").alias("pattern"), "feature", "mean", (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"), (1 - F.col("state") / 1000).alias("stability"))


_IV = f"{_SF}, iv AS (SELECT state AS pattern, feature, mean, mean - 1.96 * std / sqrt(n) AS lo, mean + 1.96 * std / sqrt(n) AS hi, 1 - state / 1000.0 AS stability FROM sf)"
_query("reliable_patterns", f"""WITH {_IV} SELECT pattern, round(max(abs(mean)), 6) AS peak, round(max(hi - lo), 6) AS width, round(max(stability), 6) AS stability FROM iv GROUP BY 1
  HAVING max(abs(mean)) >= 0.02 AND max(hi - lo) <= 0.2 AND max(stability) >= 0.5""")(lambda s, d: patterns.reliable(_intervals(s, d), 0.02, 0.2, 0.5))
_query("significant_features", f"WITH {_IV} SELECT pattern, feature FROM iv WHERE mean > 0.01 AND lo > 0.1 * (1 - stability)")(lambda s, d: patterns.significant_features(_intervals(s, d), 0.01).select("pattern", "feature"))
_query("sorted_state_index", f"""WITH {SEQ},
o AS (SELECT s.subject, st.state, count(*) FILTER (s.state = st.state) / count(*)::DOUBLE AS o FROM seq s, st GROUP BY 1, 2),
m AS (SELECT state, avg(o) AS o FROM o GROUP BY 1)
SELECT state, round(o, 6) AS occupancy, row_number() OVER (ORDER BY o DESC, state) - 1 AS sorted_index FROM m""")(lambda s, d: patterns.sorted_index(q.occupancy(v_seq(s, d), K)))


def _members(s: SparkSession, d: str, by: str = "label") -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") if by == "label" else F.col("label") % 4).alias("cluster"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("grp"), (F.col("vec_id") % 10 / 10).alias("occupancy"))


_ME = "me AS (SELECT vec_id AS id, label::BIGINT AS cluster, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, vec_id % 10 / 10.0::DOUBLE AS occupancy FROM embeddings)"
_query("consensus_mean", f"WITH {OBS}, {_ME} SELECT cluster, feature, round(avg(value), 6) AS mean, avg((value > 0.1)::INT) >= 0.5 AS consensus FROM me JOIN obs USING (id) GROUP BY 1, 2")(lambda s, d: patterns.consensus_mean(v_obs(s, d).withColumn("active", F.col("value") > 0.1), _members(s, d)))
_query("cluster_summary", f"""WITH {_ME} SELECT cluster, count(*) AS size, round(sum(occupancy), 6) AS total_occupancy, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups,
  count(*) FILTER (grp = 'a') AS n_a, count(*) FILTER (grp = 'b') AS n_b FROM me GROUP BY 1""".replace("AS groups", 'AS "groups"'))(lambda s, d: patterns.cluster_summary(_members(s, d)))
_query("cluster_overlap", f"WITH {_ME} SELECT cluster, count(*) FILTER (grp = 'a') AS n_a, count(*) FILTER (grp = 'b') AS n_b FROM me GROUP BY 1 HAVING count(DISTINCT grp) > 1")(lambda s, d: patterns.cluster_overlap(_members(s, d)))
_query("best_match", f"""WITH {_ME},
c AS (SELECT cluster AS c, count(*) AS nc FROM me GROUP BY 1),
p AS (SELECT cluster % 4 AS p, count(*) AS np FROM me GROUP BY 1),
k AS (SELECT cluster AS c, cluster % 4 AS p, count(*) AS k FROM me GROUP BY 1, 2),
b AS (SELECT c, p, k / (nc + np - k)::DOUBLE AS jaccard FROM k JOIN c USING (c) JOIN p USING (p))
SELECT c, p, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.7 THEN 'stable' WHEN jaccard >= 0.5 THEN 'moderate' ELSE 'unstable' END AS verdict
  FROM b""")(
    lambda s, d: patterns.best_match(_members(s, d), _members(s, d, "coarse"))
)
_query("assign_lost_gained", f"WITH {_ME} SELECT count(*) FILTER (occupancy < 0.6 AND occupancy > 0.2) AS common, count(*) FILTER (occupancy <= 0.2) AS lost, count(*) FILTER (occupancy >= 0.6) AS gained FROM me")(lambda s, d: patterns.lost_gained(_members(s, d).filter("occupancy < 0.6"), _members(s, d).filter("occupancy > 0.2")))
_query("split_half", f"""WITH {OBS},
h AS (SELECT *, row_number() OVER w <= count(*) OVER (PARTITION BY state, feature) // 2 AS f FROM obs WINDOW w AS (PARTITION BY state, feature ORDER
  BY id)),
m AS (SELECT state, feature, avg(value) FILTER (f) AS x, avg(value) FILTER (NOT f) AS y FROM h GROUP BY 1, 2)
SELECT state::BIGINT AS state, round(greatest(0, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12))), 6) AS stability FROM m GROUP
  BY 1""")(lambda s, d: patterns.split_half(v_obs(s, d)))

# selection and inference
_query("avg_rank", """WITH c AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, -2) AS v FROM customer)
SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY v) + (count(*) OVER (PARTITION BY c_mktsegment, v) - 1) / 2.0::DOUBLE AS rank FROM c""")(
    lambda s, d: pairs.average_rank(table(s, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", -2).alias("v")), "v", "c_mktsegment").select("c_custkey", "rank")
)
_query(
    "model_rank",
    f"""WITH {MODELS},
r AS (SELECT *, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r0, rank() OVER (ORDER BY spread) + (count(*) OVER
  (PARTITION BY spread) - 1) / 2.0 AS r1 FROM models),
f AS (SELECT *, 0.6 * r0 + 0.4 * r1 AS rank_score, 0.6 * greatest(0, least(1, 1 - abs(n / 10.0 - 15) / 30)) + 0.4 * greatest(0, least(1, 1 - abs(k -
  7) / 10.0)) AS plausibility FROM r)
SELECT model::BIGINT AS model, round(rank_score, 6) AS rank_score, round(plausibility, 6) AS plausibility, round(0.7 * rank_score + 0.3 * (1 -
  plausibility), 6) AS final FROM f""",
)(lambda s, d: inference.model_rank(v_models(s, d).withColumn("dur", F.col("n") / 10), {"score": (0.6, True), "spread": (0.4, False)}, "dur", "k").select("model", "rank_score", "plausibility", "final"))
_query("bic", f"""WITH {MODELS} SELECT model::BIGINT AS model, (k * (k - 1) + k - 1 + k * 3 + k * 6)::DOUBLE AS n_parameters, round((k * (k - 1) + k - 1 + k * 3 + k *
  6) * ln(n) - 2 * score, 5) AS bic FROM models""")(lambda s, d: inference.bic(v_models(s, d).withColumns({"d": F.lit(3), "log_likelihood": F.col("score")})).select("model", "n_parameters", F.round("bic", 5).alias("bic")))
_query("fold_summary", """WITH f AS (SELECT c_nationkey AS model, -round(c_acctbal * 100)::BIGINT AS score FROM customer),
m AS (SELECT model, avg(score) AS mean, stddev_pop(score) AS std, max(score) - min(score) AS range, count(*) FILTER (score BETWEEN -900000 AND 0) AS n_kept,
  avg(score) FILTER (score BETWEEN -900000 AND 0) AS kept_mean, count(*) AS n FROM f GROUP BY 1)
SELECT model::BIGINT AS model, round(mean, 5) AS mean, round(std, 5) AS std, "range", n_kept, round(kept_mean, 5) AS kept_mean, n,
  CASE WHEN n_kept = n THEN 'ok' WHEN n_kept > 3 THEN 'filtered' ELSE 'skipped' END AS status FROM m""")(
    lambda s, d: inference.fold_summary(table(s, d, "customer").select(F.col("c_nationkey").alias("model"), (-F.round(F.col("c_acctbal") * 100)).cast("long").alias("score")), -900000.0, 0.0).withColumns({c: F.round(c, 5) for c in ("mean", "std", "kept_mean")})
)  # whole cents: their sums are the same in any order


def _terms(s: SparkSession, d: str, view: Query = v_seq) -> DataFrame:
    """Effects estimated from the tables: mean difference of x by state of the two groups and its standard error."""
    a = F.when(F.col("grp") == "a", F.col("x"))
    b = F.when(F.col("grp") == "b", F.col("x"))
    return view(s, d).groupBy(F.col("state").alias("term")).agg(((F.avg(a) - F.avg(b)) / 100).alias("coef"), (F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)) / 100).alias("sd"))


_TERMS = f"""{SEQ},
te AS (SELECT state::BIGINT AS term, (avg(x) FILTER (grp = 'a') - avg(x) FILTER (grp = 'b')) / 100 AS coef, sqrt(var_samp(x) FILTER (grp = 'a') /
  count(*) FILTER (grp = 'a') + var_samp(x) FILTER (grp = 'b') / count(*) FILTER (grp = 'b')) / 100 AS sd FROM seq GROUP BY 1)"""


def _phi(z: str) -> str:
    """SQL of the standard normal distribution function: z + z^3/3 + z^5/15 + ... times the density, 100 terms, to |z| = 8."""
    series = "1"
    for k in range(100, 0, -1):
        series = f"1 + {z} * {z} / {2 * k + 1} * ({series})"
    return f"(CASE WHEN {z} > 8 THEN 1 WHEN {z} < -8 THEN 0 ELSE 0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * ({series}) END)"


_Z = "1.959963984540054::DOUBLE"
_BAND = "CASE WHEN bf > 100 THEN 'Extreme' WHEN bf > 30 THEN 'Very Strong' WHEN bf > 10 THEN 'Strong' WHEN bf > 3 THEN 'Moderate' WHEN bf > 1 THEN 'Anecdotal' ELSE 'None' END"
_POST = f"""{_TERMS},
zs AS (SELECT *, coef / sd AS z, (0.1 - coef) / sd AS zu, (-0.1 - coef) / sd AS zl FROM te),
po AS (SELECT *, {_phi('z')} AS up, {_phi('zu')} AS under, {_phi('zl')} AS below, least(exp(least(z * z / 2, 700)), 1e6) AS bf FROM zs)"""
_query(
    "posterior_summary",
    f"""WITH {_POST} SELECT term, round(coef, 6) AS coef, round(sd, 6) AS sd, round(up, 6) AS prob_positive, round(greatest(up, 1 - up), 6) AS prob_direction,
  round(coef - {_Z} * sd, 6) AS ci_lower, round(coef + {_Z} * sd, 6) AS ci_upper, round(under - below, 6) AS in_rope, round(1 - under, 6) AS
  above_rope, round(below, 6) AS below_rope, round(bf, 6) AS bayes_factor, round(exp(coef), 6) AS odds_ratio, {_BAND} AS evidence FROM po""",
)(lambda s, d: inference.posterior_summary(_terms(s, d)))
_query(
    "ar_evidence",
    f"""WITH {_POST},
e AS (SELECT *, coef - {_Z} * sd > 0 OR coef + {_Z} * sd < 0 OR greatest(up, 1 - up) > 0.95 AS evidence FROM po)
SELECT term, round(coef - {_Z} * sd, 6) AS ci_lower, round(coef + {_Z} * sd, 6) AS ci_upper, CASE WHEN coef > 0 THEN 'positive' ELSE 'negative' END AS
  direction, round(greatest(up, 1 - up), 6) AS prob_direction, round(1 - under + below, 6) AS prob_meaningful, evidence, bool_or(evidence) OVER () AS
  any_evidence FROM e""",
)(lambda s, d: inference.ar_evidence(_terms(s, d)))
_query("effect_sizes", f"WITH {_TERMS} SELECT term, round(coef, 6) AS coef, round(sd, 6) AS sd, round(coef / sd, 6) AS standardised, round(exp(coef), 6) AS odds_ratio FROM te")(lambda s, d: inference.effect_sizes(_terms(s, d)))
_query("group_effects", f"""WITH {_TERMS} SELECT term, round(coef * 3 , 6) AS coef_a, round(-coef, 6) AS coef_b, round(sd * sqrt(2), 6) AS sd_group, round(exp(coef * 3), 6) AS
  or_a, round(exp(-coef), 6) AS or_b FROM te""")(lambda s, d: inference.group_effects(t := _terms(s, d), t.withColumn("coef", F.col("coef") * 2)))
_query("bayes_fdr", f"""WITH {SEQ},
te AS (SELECT subject AS term, avg((state < 3)::INT) AS prob_direction FROM seq GROUP BY 1),
f AS (SELECT *, avg(1 - prob_direction) OVER (ORDER BY prob_direction DESC, term ROWS UNBOUNDED PRECEDING) AS fdr FROM te)
SELECT term, round(prob_direction, 6) AS prob_direction, round(fdr, 6) AS fdr, fdr <= 0.2 AS credible FROM f""")(
    lambda s, d: inference.bayes_fdr(v_seq(s, d).groupBy(F.col("subject").alias("term")).agg(F.avg((F.col("state") < 3).cast("int")).alias("prob_direction")), 0.2)
)
_TP = """y AS (SELECT grp, t, (state = 1)::INT AS y FROM seq),
m AS (SELECT t, avg(y) FILTER (grp = 'a') AS ma, avg(y) FILTER (grp = 'b') AS mb, var_samp(y) FILTER (grp = 'a') AS va, var_samp(y) FILTER (grp = 'b')
  AS vb, var_pop(y) FILTER (grp = 'a') AS pa, var_pop(y) FILTER (grp = 'b') AS pb, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS
  nb FROM y GROUP BY 1),
tp AS (SELECT t, na + nb - 2 AS df, CASE WHEN na > 1 AND nb > 1 THEN coalesce((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na::DOUBLE +
  1 / nb::DOUBLE)), 0), 0) END AS t_stat, CASE WHEN na > 1 AND nb > 1 THEN coalesce((ma - mb) / nullif(sqrt((pa + pb) / 2), 0), 0) END AS cohen_d FROM m)"""
_query(
    "timepoint_t",
    f"WITH {SEQ}, {_TP} SELECT t, round(t_stat, 6) AS t_stat, round(cohen_d, 6) AS cohen_d FROM tp",
)(lambda s, d: inference.timepoint_t(panel.target_indicator(v_seq(s, d), 1)))
_query("bh_fdr", f"""WITH {SEQ},
p AS (SELECT t, avg((state = 1)::INT) AS p FROM seq GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, t) AS rank, count(*) OVER () AS m FROM p)
SELECT t, round(p, 6) AS p, round(least(1, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")(lambda s, d: inference.bh_fdr(v_seq(s, d).groupBy("t").agg(F.avg((F.col("state") == 1).cast("int")).alias("p"))))
_DRAWS = """y AS (SELECT subject, grp, t, (state = 1)::INT AS y FROM seq),
u AS (SELECT DISTINCT subject, grp FROM y),
n AS (SELECT count(*) FILTER (grp = 'a') AS na FROM u),
nu AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS m FROM u),
ke AS (SELECT draw, r, md5(draw::VARCHAR || ':' || r::VARCHAR || ':3') AS k FROM range(1, 10001) d(draw), range(24) q(r)),
ks AS (SELECT draw, list(('0x' || substr(k, 1, 8))::BIGINT % 2147483646 + 1 ORDER BY r) AS a, list(('0x' || substr(k, 9, 8))::BIGINT % 2147483647 ORDER BY r) AS b,
  list(('0x' || substr(k, 17, 8))::BIGINT ORDER BY r) AS c FROM ke GROUP BY 1),
dr AS (SELECT subject, draw, list_reduce(list_prepend(i, range(24)), lambda p, r:
  CASE WHEN (((a[r + 1] * (greatest(p, (c[r + 1] % m - p + m) % m) + 1) + b[r + 1]) % 2147483647) * ((a[r + 1] * (greatest(p, (c[r + 1] % m - p + m) % m) + 1) + b[r + 1]) % 2147483647)
  % 2147483647) // 1024 % 2 = 1 THEN (c[r + 1] % m - p + m) % m ELSE p END) AS place FROM nu, ks),
ia AS (SELECT subject, draw FROM dr, n WHERE place < na UNION ALL SELECT subject, 0 FROM u WHERE grp = 'a'),
sm AS (SELECT draw, t, sum(y) AS sa, count(*) AS ca FROM ia JOIN y USING (subject) GROUP BY 1, 2),
tt AS (SELECT t, sum(y) AS s, count(*) AS c FROM y GROUP BY 1),
co AS (SELECT draw, sa / ca::DOUBLE AS x, (s - sa) / (c - ca)::DOUBLE AS z FROM sm JOIN tt USING (t) WHERE c > ca)"""
for _name, _metric, _sql in (("permutation_test", "euclidean", "sqrt(sum((x - z) ** 2))"), ("permutation_correlation", "correlation", "1 - corr(x, z)"), ("permutation_mean", "absolute_mean", "avg(abs(x - z))")):
    _query(
        _name,
        f"""WITH {SEQ}, {_DRAWS},
dd AS (SELECT draw, {_sql} AS d FROM co GROUP BY 1),
o AS (SELECT d AS observed FROM dd WHERE draw = 0)
SELECT round(observed, 6) AS observed, round(avg((d >= observed - 1e-12)::INT), 6) AS p_value, round(100 * (avg((d < observed - 1e-12)::INT) +
  avg((abs(d - observed) <= 1e-12)::INT) / 2), 6) AS percentile, round(avg(d), 6) AS null_mean, round(stddev_pop(d), 6) AS null_std, round((observed -
  avg(d)) / stddev_pop(d), 6) AS effect, round(CASE WHEN avg(d) > 0 THEN observed / avg(d) END, 6) AS fold_change FROM dd, o WHERE draw > 0 GROUP BY
  observed""",
    )(lambda s, d, metric=_metric: inference.permutation_test(panel.target_indicator(v_seq(s, d), 1), 10_000, 3, metric))
_query(
    "bootstrap_ci",
    f"""WITH {SEQ},
u AS (SELECT row_number() OVER (ORDER BY subject) - 1 AS unit, avg((state = 1)::INT) AS v FROM seq GROUP BY subject),
n AS (SELECT count(*) AS n FROM u),
sl AS (SELECT slot, draw, ('0x' || substr(md5(draw::VARCHAR || ':' || slot::VARCHAR || ':5'), 1, 8))::BIGINT % n AS unit FROM n, range(n) s(slot),
  range(1, 1001) r(draw)),
m AS (SELECT draw, avg(v) AS m FROM sl JOIN u USING (unit) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper, round(stddev_pop(m), 6) AS std FROM m""",
)(lambda s, d: inference.bootstrap_ci(numbered(v_seq(s, d).groupBy("subject").agg(F.avg((F.col("state") == 1).cast("int")).alias("v")), F.col("subject"), name="unit"), 1000, seed=5))


_query("loo_summary", f"""WITH {SEQ},
l AS (SELECT state::BIGINT AS term, grp, subject, avg(x) / 100 AS coef FROM seq GROUP BY 1, 2, 3),
m AS (SELECT term, avg(coef) FILTER (grp = 'a') AS mean_a, avg(coef) FILTER (grp = 'b') AS mean_b, stddev_samp(coef) FILTER (grp = 'a') AS sd_a,
  stddev_samp(coef) FILTER (grp = 'b') AS sd_b FROM l GROUP BY 1)
SELECT term, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(sd_a, 6) AS sd_a, round(sd_b, 6) AS sd_b, round(least(sd_a, sd_b) /
  greatest(sd_a, sd_b), 6) AS stability FROM m""")(
    lambda s, d: inference.loo_summary(v_seq(s, d).groupBy(F.col("state").alias("term"), "grp", "subject").agg((F.avg("x") / 100).alias("coef")))
)

# levels and parsed columns
_query("mean_of_means", f"""WITH {SIGNAL},
p AS (SELECT subject, network, parcel, t, avg(value) AS value FROM sig GROUP BY ALL)
SELECT subject, network, t::BIGINT AS t, round(avg(value), 6) AS value, count(*) AS n_parcels FROM p GROUP BY 1, 2, 3""")(lambda s, d: hierarchy.mean_of_means(v_signal(s, d)))
_query("network_lookup", "SELECT l_partkey AS element, p_brand AS parcel, p_type AS network, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")(lambda s, d: v_signal(s, d).groupBy("element", "parcel", "network").agg(F.count("*").alias("n")))
_query("network_missing", "SELECT DISTINCT p_type AS network FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size < 3)")(lambda s, d: hierarchy.networks_missing(table(s, d, "part").filter("p_brand in ('Brand#1', 'Brand#2') and p_size < 3").select(F.col("p_partkey").alias("parcel")), v_atlas(s, d).select(F.col("element").alias("parcel"), "network")))
_query("value_to_elements", f"""WITH {SIGNAL},
v AS (SELECT network, avg(value) AS value FROM sig GROUP BY 1)
SELECT p_partkey AS element, p_brand AS parcel, p_type AS network, round(value, 6) AS value FROM part JOIN v ON network = p_type""")(lambda s, d: hierarchy.value_to_elements(v_signal(s, d).groupBy("network").agg(F.avg("value").alias("value")), v_atlas(s, d)))
_query("props_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")))
_query("parse_list", "SELECT user_id, round(list_sum(list(value)), 4) AS total FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.col("value").cast("string")), ", "), F.lit("]")).alias("text")).select("user_id", F.round(F.aggregate(tables.parse_list(F.col("text")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
)
_query("label_token_map", "SELECT c_custkey, string_split(c_name, '#')[2] AS token FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tables.label_token(F.col("c_name"), 1, "#").alias("token")))
_query("model_name_parse", "SELECT o_orderkey, o_orderkey % 20 AS n_states FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", tables.model_states(F.concat(F.lit("both_"), (F.col("o_orderkey") % 20).cast("string"), F.lit("states"))).alias("n_states")))

# iterative models: no SQL form, tested by properties and by enumeration


def _standardised(s: SparkSession, d: str) -> DataFrame:
    return q.zscore(v_seq(s, d)).select("subject", "t", F.array(F.coalesce("z", F.lit(0.0))).alias("x"))


def _fitted(s: SparkSession, d: str) -> tuple[DataFrame, hmm.Params]:
    data = staged(_standardised(s, d))
    params, _ = hmm.fit(data, 2)
    hmm.settled(params)
    return data, params


def _hmm_decode(s: SparkSession, d: str) -> DataFrame:
    return hmm.decode(*_fitted(s, d))


def _glmm_terms(s: SparkSession, d: str) -> DataFrame:
    seq = v_seq(s, d)
    feature = seq.groupBy("t").agg((F.avg((F.col("state") == 2).cast("int")) > 0.2).cast("long").alias("f"))
    design = panel.design_matrix(panel.target_indicator(seq, 1).select("subject", "grp", "t", "y"), feature, ["f"])
    terms = {"all": ["group_coded", "f", "group_f_interaction", "y_lag1"], "f": ["group_coded", "f"]}
    return inference.posterior_summary(glmm.term_table(s, glmm.fit(design, terms), terms))


def _hmm_grid(s: SparkSession, d: str) -> DataFrame:
    """2 to 7 states for either group and both together: likelihood, BIC and place of each number of states; at most 100 rounds, `converged` says which settled."""
    data = staged(q.zscore(v_seq(s, d)).select("subject", "t", F.array(F.coalesce("z", F.lit(0.0))).alias("x"), "grp"))
    chosen = grid.selected(grid.fit_grid(data, list(range(2, 8)), {"a": ["a"], "b": ["b"], "both": ["a", "b"]}, restarts=2, most_rounds=100))
    return chosen.drop("start", "transition", "mean", "cov", "d")


_query("hmm_grid", None)(_hmm_grid)
_query("hmm_decode", None)(_hmm_decode)
_query("glmm_terms", None)(_glmm_terms)
_query("pattern_clusters", None)(lambda s, d: clustering.average_linkage(_patterns(s, d), 0.6))

# clusters over thresholds, totals and printed forms


def _assigned(s: SparkSession, d: str) -> DataFrame:
    """A threshold for each component: a vector stands where its own is positive, so vectors come, go and return."""
    e = v_obs(s, d).filter("value > 0")
    return e.select((F.col("feature") / 64).alias("threshold"), "id", (F.col("state") % (F.col("feature") % 7 + 4)).alias("cluster"))


_ASG = "asg AS (SELECT i, round(i / 64.0::DOUBLE, 6) AS threshold, vec_id AS id, label % (i % 7 + 4) AS cluster FROM embeddings, range(64) r(i) WHERE embedding[i + 1] > 0)"
_query("threshold_stats", f"""WITH {_ASG},
z AS (SELECT threshold, cluster, count(*) AS n FROM asg GROUP BY 1, 2)
SELECT threshold, count(*) AS n_clusters, sum(n)::BIGINT AS n_patterns, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(count(*) /
  sum(n)::DOUBLE, 6) AS fragmentation FROM z GROUP BY 1""")(lambda s, d: clustering.threshold_stats(_assigned(s, d)))
_query(
    "lifecycle",
    f"""WITH {_ASG},
z AS (SELECT *, count(*) OVER (PARTITION BY i, cluster) AS size, coalesce((lag(cluster) OVER (PARTITION BY id ORDER BY i) <> cluster)::INT, 0) AS ch
  FROM asg)
SELECT id, count(*) AS persistence, min(threshold) AS first, max(threshold) AS last, max(i) - min(i) + 1 > count(*) AS has_gaps, sum(ch)::BIGINT AS
  cluster_changes, CASE WHEN arg_max(size, i) > 1.2 * arg_min(size, i) THEN 'growing' WHEN arg_max(size, i) < 0.8 * arg_min(size, i) THEN 'shrinking'
  ELSE 'stable' END AS size_trend FROM z GROUP BY id""".replace("AS first", 'AS "first"').replace("AS last", 'AS "last"'),
)(lambda s, d: clustering.lifecycles(_assigned(s, d)))
_query("first_model", "SELECT label::BIGINT AS cluster, min(vec_id % 20) AS n_states, arg_min(vec_id, (vec_id % 20) * 10000000 + vec_id) AS state FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1")(
    lambda s, d: clustering.first_model(_members(s, d).select("cluster", "grp", (F.col("id") % 20).alias("n_states"), F.col("id").alias("state")), "a")
)
_query("annotation_totals", f"WITH {_AS} SELECT count(*) AS n_words, count(DISTINCT story) AS n_stories, sum(is_verb::INT)::BIGINT AS n_is_verb, round(avg(is_verb::INT), 6) AS share_is_verb FROM asw")(lambda s, d: align.annotation_totals(_tagged(s, d), ["is_verb"]))
_query(
    "format_effects",
    """WITH e AS (SELECT o_orderkey, (o_orderkey % 1009) / 1009.0::DOUBLE AS p, (o_orderkey % 150 * (CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 1
  END))::DOUBLE AS b, o_orderkey % 400 / 128.0::DOUBLE - 1 AS c, (o_orderkey % 50 + 1) / 64.0::DOUBLE AS sd, o_orderkey % 3 = 0 AS credible FROM
  orders),
t AS (SELECT *, CASE WHEN b >= 100 THEN '***' WHEN b >= 10 THEN '**' WHEN b >= 3 THEN '*' ELSE '' END AS stars FROM e)
SELECT o_orderkey, CASE WHEN p > 0.999 THEN '>0.999' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS prob_text, stars, CASE WHEN b > 10000
  THEN printf('%.2e', b) ELSE printf('%.2f', b) END AS factor_text, trim(printf('%.3f', c) || ' \u00b1 ' || printf('%.3f', sd) || ' ' || stars) AS
  effect_text, printf('%.3f', c) || CASE WHEN credible THEN ' \u2020' ELSE '' END AS diff_text FROM t""",
)(
    lambda s, d: inference.format_effects(
        table(s, d, "orders").select(
            "o_orderkey", (F.col("o_orderkey") % 1009 / 1009).alias("prob"), (F.col("o_orderkey") % 150 * F.when(F.col("o_orderkey") % 7 == 0, 1000).otherwise(1)).cast("double").alias("bayes_factor"),
            (F.col("o_orderkey") % 400 / 128 - 1).alias("coef"), ((F.col("o_orderkey") % 50 + 1) / 64).alias("sd"), (F.col("o_orderkey") % 400 / 128 - 1).alias("diff"), (F.col("o_orderkey") % 3 == 0).alias("credible"),
        )
    ).select("o_orderkey", "prob_text", "stars", "factor_text", "effect_text", "diff_text")
)
_query("effect_order", f"""WITH {SEQ},
e AS (SELECT state::BIGINT AS term, grp, exp(avg(x) / 1000) AS o FROM seq GROUP BY 1, 2),
m AS (SELECT term, max(abs(o - 1)) AS size FROM e GROUP BY 1 HAVING count(DISTINCT grp) = 2)
SELECT term, round(size, 6) AS size, row_number() OVER (ORDER BY size DESC, term) AS place FROM m""")(
    lambda s, d: inference.effect_order(v_seq(s, d).groupBy(F.col("state").alias("term"), "grp").agg(F.exp(F.avg("x") / 1000).alias("odds_ratio")))
)

# serial checks, model metrics and tables over thresholds
_query("transition_rate", f"WITH {SEQ} SELECT grp, round(count(*) FILTER (prev <> state) / count(prev)::DOUBLE, 6) AS transition_rate FROM chg GROUP BY 1")(lambda s, d: q.transition_rate(v_seq(s, d), "grp"))
_query(
    "mutual_info",
    f"""WITH {SEQ},
c AS (SELECT grp, state, t // 9 AS b, count(*)::DOUBLE AS n FROM seq GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS al_n, sum(n) OVER (PARTITION BY grp, state) AS na, sum(n) OVER (PARTITION BY grp, b) AS nb FROM c)
SELECT grp, round({_MI}, 6) AS mutual_info FROM m GROUP BY 1""",
)(lambda s, d: pairs.mutual_information(v_seq(s, d).groupBy("grp", "state", F.floor(F.col("t") / 9).alias("b")).agg(F.count("*").alias("n")), ["grp"], "state", "b"))
_LJ = """c AS (SELECT subject, t, x - avg(x) OVER (PARTITION BY subject) AS d, count(*) OVER (PARTITION BY subject) AS n FROM seq),
v AS (SELECT subject, sum(d * d) AS v FROM c GROUP BY 1),
r AS (SELECT a.subject, l.lag, any_value(a.n) AS n, sum(a.d * b.d) / any_value(v.v) AS r FROM range(1, 11) l(lag), c a JOIN c b ON a.subject =
  b.subject AND a.t = b.t + l.lag JOIN v ON v.subject = a.subject WHERE a.n >= 25 GROUP BY 1, 2),
lb AS (SELECT *, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY subject ORDER BY lag) AS statistic FROM r)"""
_query(
    "ljung_box",
    f"WITH {SEQ}, {_LJ} SELECT subject, lag, round(r, 6) AS autocorrelation, round(statistic, 6) AS statistic FROM lb",
)(lambda s, d: curves.ljung_box(v_seq(s, d)).select("subject", "lag", "autocorrelation", "statistic"))
# tails in SQL: the series of the lower gamma function, and the finite sums of the t distribution for whole degrees of freedom
_CHI_SUM = "(SELECT sum(exp((lag / 2.0 + m) * ln(statistic / 2) - statistic / 2 - lgamma(lag / 2.0 + m + 1))) FROM range(600) g(m))"
_T_SUM = """list_sum(list_transform(range((df + 1) // 2), lambda k: CASE WHEN df % 2 = 0 THEN exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1::DOUBLE)) / sqrt(pi()) * c ** (2 * k)
  WHEN 2 * k + 1 < df THEN exp(lgamma(k + 1::DOUBLE) - lgamma(k + 1.5::DOUBLE)) / sqrt(pi()) * c ** (2 * k + 1) ELSE 0 END))"""
_T_TAIL = f"1 - CASE WHEN df % 2 = 0 THEN sqrt(1 - c * c) * {_T_SUM} ELSE 2 / pi() * acos(c) + sqrt(1 - c * c) * {_T_SUM} END"
_query(
    "ljung_box_p",
    f"""WITH {SEQ}, {_LJ},
p AS (SELECT *, CASE WHEN statistic > 400 THEN 0.0 WHEN statistic <= 0 THEN 1.0 ELSE 1 - {_CHI_SUM} END AS p FROM lb)
SELECT subject, lag, round(r, 6) AS autocorrelation, round(statistic, 6) AS statistic, round(p, 6) AS p_value, min(p) OVER (PARTITION BY subject) < 0.05 AS serial FROM p""",
)(lambda s, d: curves.ljung_box(v_seq(s, d)))
_query(
    "residualise",
    f"""WITH {SEQ},
f AS (SELECT subject, regr_slope(x, t) AS bx, regr_intercept(x, t) AS ax, regr_slope(state, t) AS bs, regr_intercept(state, t) AS as_ FROM seq GROUP
  BY 1),
r AS (SELECT s.subject, t, x - ax - bx * t AS rx, state - as_ - bs * t AS rs FROM seq s JOIN f USING (subject)),
g AS (SELECT subject, sum(rx * rs) / sum(rs * rs) AS b FROM r GROUP BY 1),
e AS (SELECT subject, t, rx - b * rs AS residual FROM r JOIN g USING (subject))
SELECT subject, t, round(residual, 6) AS residual, round((residual - avg(residual) OVER w) / stddev_samp(residual) OVER w, 6) AS z FROM e WINDOW w AS
  (PARTITION BY subject)""",
)(lambda s, d: curves.residualise(v_seq(s, d), ["t", "state"]).select("subject", "t", "residual", "z"))
_query(
    "variance_inflation",
    f"WITH {SEQ} SELECT unnest(['state', 't']) AS term, round(1 / (1 - sum(state * t)::DOUBLE ** 2 / (sum(state * state)::DOUBLE * sum(t * t))), 6) AS vif FROM seq",
)(lambda s, d: curves.variance_inflation(v_seq(s, d), ["state", "t"]))
_query(
    "knee_point",
    f"""WITH {_PK},
g AS (SELECT round((round(quantile_cont(agreement, 0.85), 2) - 0.05) / 0.01)::INT AS lo, round(round(quantile_cont(agreement, 0.95), 2) / 0.01)::INT
  AS hi FROM (SELECT round(agreement, 9) AS agreement FROM ag)),
k AS (SELECT round(unnest(range(lo, hi + 1)) * 0.01::DOUBLE, 2) AS threshold FROM g),
cu AS (SELECT threshold AS x, (SELECT count(*) FROM pk WHERE prominence >= threshold) AS y FROM k),
un AS (SELECT x, (x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) AS u, 1 - (y - min(y) OVER ()) / nullif(max(y) OVER () - min(y)
  OVER (), 0)::DOUBLE AS v, count(*) OVER () AS n FROM cu),
be AS (SELECT *, v - u AS d, lag(v - u) OVER (ORDER BY x) AS bef, lead(v - u) OVER (ORDER BY x) AS aft FROM un),
tu AS (SELECT *, CASE WHEN d >= bef AND d >= aft THEN x END AS top, CASE WHEN d >= bef AND d >= aft THEN d - 2.0::DOUBLE / (n - 1) WHEN d <= bef AND d
  <= aft THEN 0::DOUBLE END AS bar FROM be),
st8 AS (SELECT aft, last_value(top IGNORE NULLS) OVER w AS knee, last_value(bar IGNORE NULLS) OVER w AS bar FROM tu WINDOW w AS (ORDER BY x ROWS
  UNBOUNDED PRECEDING))
SELECT 'all' AS series, round(min(knee), 6) AS knee FROM st8 WHERE knee IS NOT NULL AND aft < bar HAVING count(*) > 0""",
)(lambda s, d: curves.knee_point(align.threshold_sweep(align.peaks(x := _series(s, d)), x).select(F.lit("all").alias("series"), F.col("threshold").alias("x"), F.col("n_peaks").alias("y"))))
_query(
    "timepoint_p",
    f"""WITH {SEQ}, {_TP},
g AS (SELECT *, sqrt(df / (df + t_stat * t_stat)) AS c FROM tp),
p AS (SELECT *, CASE WHEN t_stat IS NOT NULL THEN {_T_TAIL} END AS p FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY p, t) AS rank, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT t, least(1, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
SELECT t, round(t_stat, 6) AS t_stat, round(cohen_d, 6) AS cohen_d, df, round(p, 6) AS p, round(q, 6) AS q FROM p LEFT JOIN q USING (t)""",
)(lambda s, d: inference.timepoint_p(panel.target_indicator(v_seq(s, d), 1)))


def _rank_correlation_p(s: SparkSession, d: str) -> DataFrame:
    means = v_obs(s, d).groupBy(F.col("state").alias("id"), "feature").agg(F.avg("value").alias("value"))
    return inference.rank_correlation_p(pairs.spearman_pairs(means), means.agg(F.count_distinct("feature")).first()[0])


_query(
    "rank_correlation_p",
    f"""WITH {_SP},
g AS (SELECT *, sqrt(1 - least(1, rho * rho)) AS c FROM sp)
SELECT a, b, round(rho, 6) AS rho, round(CASE WHEN df > 0 THEN {_T_TAIL} END, 6) AS p_value,
  CASE WHEN abs(rho) >= 0.7 THEN 'strong' WHEN abs(rho) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM g""",
)(_rank_correlation_p)
_query(
    "pattern_cosine",
    f"""WITH {OBS},
o AS (SELECT id % 10 AS subject, state::BIGINT AS state, feature, avg(value) AS x FROM obs GROUP BY ALL),
w AS (SELECT state::BIGINT AS state, feature, avg(value) AS y FROM obs GROUP BY ALL)
SELECT subject, state, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12), 6) AS cosine FROM o JOIN w USING (state, feature) GROUP BY 1,
  2""",
)(lambda s, d: patterns.pattern_consistency(v_obs(s, d).withColumn("subject", F.col("id") % 10)))
_query("state_distance", f"WITH {_SF} SELECT x.state AS a, y.state AS b, round(sqrt(sum((x.mean - y.mean) ** 2)), 6) AS distance FROM sf x JOIN sf y ON x.feature = y.feature AND x.state < y.state GROUP BY 1, 2")(
    lambda s, d: patterns.state_distance(patterns.state_feature_stats(v_obs(s, d)))
)
_query(
    "state_separability",
    f"""WITH {SEQ},
m AS (SELECT subject, state, count(*) AS n, avg(x) AS mx, avg(t) AS mt, covar_pop(x, x) AS xx, covar_pop(x, t) AS xt, covar_pop(t, t) AS tt FROM seq GROUP BY 1, 2),
p AS (SELECT subject, sum(n * xx) / sum(n) AS xx, sum(n * xt) / sum(n) AS xt, sum(n * tt) / sum(n) AS tt FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN (xx + tt - sqrt((xx - tt) ** 2 + 4 * xt * xt)) / 2 < 1e-6 THEN 1e-6::DOUBLE ELSE 0 END AS ridge FROM p)
SELECT a.subject, a.state::BIGINT AS a, b.state::BIGINT AS b, round(sqrt((a.mx - b.mx) ** 2 + (a.mt - b.mt) ** 2), 6) AS euclidean,
  round(sqrt(((a.mx - b.mx) ** 2 * (r.tt + ridge) - 2 * (a.mx - b.mx) * (a.mt - b.mt) * r.xt + (a.mt - b.mt) ** 2 * (r.xx + ridge)) / ((r.xx + ridge) * (r.tt + ridge) - r.xt * r.xt)), 6) AS mahalanobis
FROM m a JOIN m b ON a.subject = b.subject AND a.state < b.state JOIN r ON r.subject = a.subject""",
)(lambda s, d: linear.separability(linear.state_moments(v_seq(s, d).withColumn("x", F.array("x", F.col("t").cast("double"))), 2)))


def _mixing(s: SparkSession, d: str) -> DataFrame:
    """Of every subject's chain of the target state and all others."""
    on = (F.col("state") == 1).cast("int")
    step = v_seq(s, d).select("subject", F.lag(on).over(W.partitionBy("subject").orderBy("t")).alias("before"), on.alias("after")).filter("before is not null")
    return linear.mixing(step.groupBy("subject", "before", "after").agg(F.count("*").alias("n")), 2)


_query(
    "mixing_rate",
    f"""WITH {SEQ},
p AS (SELECT subject, coalesce(avg((state = 1)::INT) FILTER (prev = 1), 1) AS stay, coalesce(avg((state <> 1)::INT) FILTER (prev <> 1), 1) AS away FROM chg WHERE prev IS NOT NULL GROUP BY 1)
SELECT subject, round(abs(stay + away - 1), 6) AS second, round(1 - abs(stay + away - 1), 6) AS mixing_rate FROM p""",
)(_mixing)
_query(
    "consensus_check",
    f"""WITH {OBS}, {_ME},
st1 AS (SELECT cluster, feature, avg((value > 0.1)::INT) >= 0.5 AS stored FROM me JOIN obs USING (id) WHERE grp = 'a' GROUP BY 1, 2),
f AS (SELECT cluster, feature, avg((value > 0.1)::INT) AS frequency FROM me JOIN obs USING (id) GROUP BY 1, 2)
SELECT f.cluster, f.feature, round(frequency, 6) AS frequency, (frequency >= 0.5) = coalesce(stored, false) AS matches FROM f LEFT JOIN st1 USING
  (cluster, feature)""",
)(lambda s, d: patterns.consensus_check(v := v_obs(s, d).select("id", "feature", "value", (F.col("value") > 0.1).alias("active")), m := _members(s, d), patterns.consensus_mean(v, m.filter("grp = 'a'"))))
_query(
    "model_state_pivot",
    """SELECT 'a_' || vec_id % 20 || 'states' AS model, vec_id % 20 AS n_states, min(label) FILTER (vec_id // 20 % 4 = 0)::BIGINT AS s0, min(label) FILTER
  (vec_id // 20 % 4 = 1)::BIGINT AS s1, min(label) FILTER (vec_id // 20 % 4 = 2)::BIGINT AS s2, min(label) FILTER (vec_id // 20 % 4 = 3)::BIGINT AS s3
  FROM embeddings GROUP BY 1, 2""",
)(
    lambda s, d: patterns.model_state_pivot(
        table(s, d, "embeddings").select(F.concat(F.lit("a_"), (F.col("vec_id") % 20).cast("string"), F.lit("states")).alias("model"), (F.floor(F.col("vec_id") / 20) % 4).cast("int").alias("sorted_state"), F.col("label").alias("cluster")), 4
    )
)
_query(
    "model_consistency",
    f"""WITH {OBS},
e AS (SELECT state % 3 AS model, state, id % 10 AS subject, avg((value > 0.1)::INT) AS o, avg(value) AS c, avg(abs(value)) AS h FROM obs GROUP BY 1, 2, 3),
b AS (SELECT model, state, avg(o) AS o, var_pop(c) AS c, avg(h) AS h FROM e GROUP BY 1, 2)
SELECT model::BIGINT AS model, round(100 * avg((o < 0.25)::INT), 6) AS pct_low_freq, round(max(c), 6) AS max_pattern_var, round(avg(h), 6) AS
  mean_stability FROM b GROUP BY 1""",
)(
    lambda s, d: patterns.model_consistency(
        v_obs(s, d).groupBy((F.col("state") % 3).alias("model"), "state", (F.col("id") % 10).alias("subject"))
        .agg(F.avg((F.col("value") > 0.1).cast("double")).alias("occupancy"), F.avg("value").alias("cosine"), F.avg(F.abs("value")).alias("stability")), 0.25
    )
)
_query(
    "model_rank_penalised",
    f"""WITH {MODELS},
r AS (SELECT *, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r0, rank() OVER (ORDER BY spread) +
  (count(*) OVER (PARTITION BY spread) - 1) / 2.0::DOUBLE AS r1, ln(1 + k) / ln(1 + max(k) OVER ()) AS pen FROM models)
SELECT model::BIGINT AS model, round((0.3::DOUBLE * r0 + 0.2::DOUBLE * r1) / 0.5, 6) AS rank_score, round(1 - pen, 6) AS explainability,
  round((0.3::DOUBLE * r0 + 0.2::DOUBLE * r1) / 0.5 * (1 + 0.2::DOUBLE * pen), 6) AS final FROM r""",
)(lambda s, d: inference.model_rank_penalised(v_models(s, d), {"score": (0.3, True), "spread": (0.2, False)}, "k").select("model", "rank_score", "explainability", "final"))
_TK = f"""{_ASG},
sz AS (SELECT threshold, cluster::BIGINT AS cluster, count(*) AS size FROM asg GROUP BY 1, 2),
tk AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY size DESC, cluster) AS place, count(*) OVER (PARTITION BY threshold) AS
  n_clusters, sum(size) OVER (PARTITION BY threshold)::BIGINT AS n_patterns FROM sz)"""
_query("topk_clusters", f"WITH {_TK} SELECT * FROM tk WHERE place <= 5")(lambda s, d: clustering.top_clusters(_assigned(s, d)))
_query(
    "signature_tracking",
    f"""WITH {_TK}, {OBS},
p AS (SELECT id AS pattern_id, feature FROM obs WHERE value > 0),
k AS (SELECT threshold, cluster, feature, count(*) AS k FROM asg JOIN p ON p.pattern_id = asg.id GROUP BY ALL),
sg AS (SELECT threshold, cluster, string_agg(feature::VARCHAR, ' ' ORDER BY feature) AS signature FROM k JOIN sz USING (threshold, cluster) WHERE 2 *
  k.k >= size GROUP BY 1, 2),
j AS (SELECT threshold, cluster, place, size, signature FROM tk JOIN sg USING (threshold, cluster) WHERE place <= 5),
g AS (SELECT signature, count(*) AS persistence, 'G' || row_number() OVER (ORDER BY count(*) DESC, signature) AS cluster_group FROM j GROUP BY 1),
n AS (SELECT threshold, count(DISTINCT signature) AS n_signatures FROM j GROUP BY 1)
SELECT threshold, cluster, place, size, signature, persistence, cluster_group, n_signatures FROM j JOIN g USING (signature) JOIN n USING (threshold)""",
)(lambda s, d: clustering.signature_tracking(clustering.top_clusters(a := _assigned(s, d)), clustering.signatures(a, v_obs(s, d).filter("value > 0").select(F.col("id").alias("pattern_id"), "feature"))))
_query(
    "lifecycle_xtab",
    f"""WITH c AS ({_ORACLES['lifecycle']})
SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, count(*) FILTER (size_trend = 'growing') AS growing, count(*) FILTER (size_trend =
  'shrinking') AS shrinking, count(*) FILTER (size_trend = 'stable') AS stable, count(*) FILTER (has_gaps) AS with_gaps, count(*) FILTER (NOT
  has_gaps) AS without_gaps FROM c GROUP BY 1""",
)(lambda s, d: clustering.lifecycle_xtab(clustering.lifecycles(_assigned(s, d)), _members(s, d).select("id", "grp")))
_query(
    "feature_summary",
    f"""WITH {SEQ} SELECT state::BIGINT AS feature, round(avg(x) FILTER (grp = 'a') / 1000, 6) AS group_effect, round(avg((x > 100)::INT) FILTER (grp = 'a'),
  6) AS group_prob, round(exp(avg(x) FILTER (grp = 'a') / 1000), 6) AS group_odds_ratio, round(avg(x) FILTER (grp = 'b') / 1000, 6) AS
  interaction_effect, round(avg((x > 100)::INT) FILTER (grp = 'b'), 6) AS interaction_prob, round(exp(avg(x) FILTER (grp = 'b') / 1000), 6) AS
  interaction_odds_ratio, avg((x > 100)::INT) FILTER (grp = 'b') > 0.4 AS fdr_credible FROM seq GROUP BY 1""",
)(
    lambda s, d: inference.feature_summary(
        v_seq(s, d).withColumn("term", F.when(F.col("grp") == "a", "group_coded").otherwise(F.concat(F.lit("group_"), F.col("state").cast("string"), F.lit("_interaction"))))
        .groupBy(F.col("state").alias("feature"), "term").agg((F.avg("x") / 1000).alias("coef"), F.avg((F.col("x") > 100).cast("double")).alias("prob_positive"), F.exp(F.avg("x") / 1000).alias("odds_ratio"))
        .withColumn("credible", F.col("prob_positive") > 0.4)
    )
)
_query("string_utils", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sub-' ELSE '' END || o_orderkey AS raw, 'sub-' || o_orderkey AS name, printf('%03d', o_orderkey % 101) AS token FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "sub-").otherwise(""), F.col("o_orderkey").cast("string")).alias("raw"), (F.col("o_orderkey") % 101 / 100).alias("v"))
    .select("o_orderkey", "raw", tables.prefixed(F.col("raw")).alias("name"), tables.threshold_token(F.col("v")).alias("token"))
)
_query("array_utils", """SELECT vec_id, array_to_string(list_filter(range(64), lambda i: embedding[i + 1]::DOUBLE > 0.1), ',') AS active,
  array_to_string(list_transform(list_filter(range(64), lambda i: embedding[i + 1]::DOUBLE > 0.1), lambda i: 'n' || i), ',') AS names,
  round(len(list_filter(range(64), lambda i: embedding[i + 1]::DOUBLE > 0.1)) / 64.0::DOUBLE, 6) AS share FROM embeddings""")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    .select("vec_id", F.array_join(arrays.active_indices(F.col("v"), 0.1).cast("array<string>"), ",").alias("active"), F.array_join(arrays.active_names(F.col("v"), [f"n{i}" for i in range(WIDTH)], 0.1), ",").alias("names"), arrays.share_active(F.col("v"), 0.1).alias("share"))
)
#: Fixed value: the thresholds of the sweep.
LINKAGE = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _usage(s: SparkSession, d: str) -> DataFrame:
    """Patterns of the subjects: states that take more than an even share of the first, and of the second half of the subject's steps."""
    own = W.partitionBy("subject")
    seq = v_seq(s, d).withColumn("half", (2 * F.col("t") >= F.count("*").over(own)).cast("int"))
    share = seq.groupBy("subject", "half", "state").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("subject", "half")))
    return share.filter(F.col("n") * K > F.col("all")).select(F.col("subject").alias("pattern_id"), (F.col("half") * K + F.col("state")).alias("feature"))


def _usage_clusters(s: SparkSession, d: str) -> DataFrame:
    return clustering.linkage_sweep(_usage(s, d), LINKAGE).withColumnRenamed("pattern_id", "id")


_query("usage_join", f"""WITH {SEQ},
h AS (SELECT subject, state, (2 * t >= count(*) OVER (PARTITION BY subject))::INT AS half FROM seq),
c AS (SELECT subject, half * {K} + state AS feature, count(*) AS n, sum(count(*)) OVER (PARTITION BY subject, half) AS m FROM h GROUP BY subject, half, state),
sets AS (SELECT subject, list(feature ORDER BY feature) AS fs FROM c WHERE n * {K} > m GROUP BY 1),
it AS (SELECT min(subject) AS item, fs FROM sets GROUP BY fs),
j AS (SELECT x.item AS a, y.item AS b, len(list_intersect(x.fs, y.fs)) AS s, len(x.fs) + len(y.fs) AS k FROM it x JOIN it y ON x.item < y.item)
SELECT a, b, round(s / (k - s)::DOUBLE, 6) AS similarity FROM j WHERE s / (k - s)::DOUBLE >= {min(LINKAGE)} - 1e-12""")(lambda s, d: pairs.similar_patterns(clustering.distinct_patterns(_usage(s, d))[0], min(LINKAGE)))
_query("usage_dendrogram", None)(lambda s, d: clustering.linkage_merges(_usage(s, d), min(LINKAGE))[1])
_query("usage_sweep", None)(lambda s, d: clustering.threshold_stats(_usage_clusters(s, d)))
_query("usage_lifecycle", None)(lambda s, d: clustering.lifecycles(staged(_usage_clusters(s, d))))
_query("pattern_sweep", None)(lambda s, d: clustering.linkage_sweep(_patterns(s, d), [0.6, 0.7, 0.8, 0.9]))
_query("pattern_pca", None)(lambda s, d: patterns.embed(table(s, d, "embeddings").select("vec_id", "label", "embedding")).drop("embedding"))


def _hmm_cross_validation(s: SparkSession, d: str) -> DataFrame:
    data, full = _fitted(s, d)
    return hmm.cross_validate(data.withColumn("fold", (F.col("subject") % 3).cast("int")), full)[1]


def _hmm_confusion(s: SparkSession, d: str) -> DataFrame:
    return hmm.confusion(*_fitted(s, d))


def _glmm_folds(s: SparkSession, d: str) -> DataFrame:
    seq = v_seq(s, d)
    feature = seq.groupBy("t").agg((F.avg((F.col("state") == 2).cast("int")) > 0.2).cast("long").alias("f"))
    design = panel.design_matrix(panel.target_indicator(seq, 1).select("subject", "grp", "t", "y"), feature, ["f"])
    return glmm.leave_out(design.withColumn("fold", (F.col("subject") % 3).cast("int")), ["group_coded", "f"], [0, 1, 2])


def _hmm_leave_one_out(s: SparkSession, d: str) -> DataFrame:
    """One subject a fold: likelihood and share of state 0 of each subject under the model of the others, and how well its states match those of all other folds."""
    data, full = _fitted(s, d)
    data = data.withColumn("fold", F.col("subject").cast("long"))
    models = hmm.leave_out(data, full)
    matched = diagnostics.fold_reliability(hmm.fold_means(models, 2, 1)).select("fold", "reliability")
    scores = hmm.score_folds(data, models, 2)
    share = F.size(F.filter("path", lambda state: state == 0)) / F.col("n")
    return scores.join(matched, "fold", "left").select("subject", "n", "log_likelihood", share.alias("share_state_0"), "reliability", "converged")


def _sweep_design(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Features: at which steps each state but the target's is frequent."""
    seq, states = v_seq(s, d), [0, 2, 3, 4]
    names = [f"often_{k}" for k in states]
    often = seq.groupBy("t").agg(*[(F.avg((F.col("state") == k).cast("int")) > 0.2).cast("long").alias(f) for k, f in zip(states, names)])
    return panel.design_matrix(panel.target_indicator(seq, 1).select("subject", "grp", "t", "y"), often, names), names


def _glmm_sweep(s: SparkSession, d: str) -> DataFrame:
    design, names = _sweep_design(s, d)
    terms = glmm.feature_sweep(names, ["y_lag1", "y_lag2"])
    fitted = glmm.fit(design, terms, fallback=True)
    return inference.posterior_summary(glmm.evidence_table(s, fitted, terms, "null"))


def _glmm_leave_one_out(s: SparkSession, d: str) -> DataFrame:
    design, names = _sweep_design(s, d)
    return glmm.leave_one_out(design.withColumn("fold", F.col("subject").cast("int")), ["group_coded", *names[:3]])


def _fold_states(s: SparkSession, d: str) -> DataFrame:
    """Mean vectors of five states in eight folds of the vectors."""
    means = v_obs(s, d).groupBy((F.col("id") % 8).alias("fold"), (F.col("state") % 5).alias("state"), "feature").agg(F.avg("value").alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda r: r["v"])
    return means.groupBy("fold", "state").agg(values.alias("x"))


_query("hmm_leave_one_out", None)(_hmm_leave_one_out)
_query("glmm_sweep", None)(_glmm_sweep)
_query("glmm_leave_one_out", None)(_glmm_leave_one_out)
_query(
    "state_reliability",
    f"""WITH {OBS},
m AS (SELECT id % 8 AS fold, state % 5 AS state, feature, avg(value) AS v FROM obs GROUP BY 1, 2, 3),
c AS (SELECT x.fold AS a, y.fold AS b, x.state AS s, y.state AS r, sum(x.v * y.v) / ((sqrt(sum(x.v * x.v)) + 1e-12) * (sqrt(sum(y.v * y.v)) + 1e-12)) AS cosine
  FROM m x JOIN m y ON x.feature = y.feature AND x.fold <> y.fold GROUP BY 1, 2, 3, 4),
st5 AS (SELECT unnest(range(5)) AS s),
pm AS (SELECT [p.s, q.s, r.s, t.s, u.s] AS order_ FROM st5 p, st5 q, st5 r, st5 t, st5 u WHERE len(list_distinct([p.s, q.s, r.s, t.s, u.s])) = 5),
g AS (SELECT a, b, order_, avg(cosine) AS matched FROM pm, c WHERE order_[s + 1] = r GROUP BY 1, 2, 3),
best AS (SELECT a, b, max(matched) AS matched FROM g GROUP BY 1, 2)
SELECT a AS fold, round(avg(matched), 6) AS reliability, count(*) AS n_pairs FROM best GROUP BY 1""",
)(lambda s, d: diagnostics.fold_reliability(_fold_states(s, d)))
_query("hmm_cross_validation", None)(_hmm_cross_validation)
_query("hmm_confusion", None)(_hmm_confusion)
_query("glmm_folds", None)(_glmm_folds)

_WEIGHT = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in inference.poisson_steps())
_query(
    "pair_summary",
    f"""WITH {_AL},
ov AS (SELECT a, b, avg((sa = sb)::INT) AS v FROM al GROUP BY 1, 2),
u AS (SELECT d, v, ('0x' || substr(md5(a || ':' || b || ':' || d || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ov, range(1, 51) r(d)),
w AS (SELECT d, v, {_WEIGHT} AS w FROM u),
m AS (SELECT d, sum(w * v) / sum(w) AS m FROM w GROUP BY 1)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n, (SELECT round(quantile_cont(m, 0.025), 6) FROM m) AS ci_lower, (SELECT
  round(quantile_cont(m, 0.975), 6) FROM m) AS ci_upper FROM ov""",
)(lambda s, d: inference.overlap_bootstrap(v_seq(s, d), 50))

# report tables
_query(
    "effect_table",
    f"""WITH {_TERMS},
b AS (SELECT *, least(exp(least((coef / sd) ** 2 / 2, 700)), 1e6) AS bf FROM te)
SELECT term, round(coef, 3) AS coef, round(sd, 3) AS sd, round(exp(coef), 3) AS odds_ratio, round(exp(coef - {_Z} * sd), 3) AS or_lower,
  round(exp(coef + {_Z} * sd), 3) AS or_upper, round(bf, 2) AS bayes_factor, CASE WHEN bf > 100 THEN 'Extreme' WHEN bf > 30 THEN 'Very Strong' WHEN bf
  > 10 THEN 'Strong' WHEN bf > 3 THEN 'Moderate' WHEN bf > 1 THEN 'Anecdotal' ELSE 'None' END AS evidence, row_number() OVER (ORDER BY bf DESC, term)
  AS place FROM b""",
)(lambda s, d: reports.effect_table(_terms(s, d)).drop("prob_positive"))
_query(
    "group_table",
    f"""WITH {_TERMS},
g AS (SELECT term, round(coef * 3, 3) AS coef_a, round(exp(coef * 3), 3) AS or_a, round(-coef, 3) AS coef_b, round(exp(-coef), 3) AS or_b, round(coef
  * 2, 3) AS diff FROM te)
SELECT *, row_number() OVER (ORDER BY abs(diff) DESC, term) AS place FROM g""",
)(lambda s, d: reports.group_table(t := _terms(s, d), t.withColumn("coef", F.col("coef") * 2)).drop("prob_positive_a", "prob_positive_b", "prob_stronger"))
_GP = {"a": ("coef", "sd"), "b": ("coef * 3", "sd * sqrt(2)")}
_query(
    "group_posteriors",
    f"WITH {_TERMS}, g AS (SELECT term, coef * 2 AS diff, sd AS sd_diff, "
    + ", ".join(f"{c} AS coef_{g}, {sd} AS sd_{g}, {c} / ({sd}) AS z_{g}" for g, (c, sd) in _GP.items())
    + ", coef * 2 / sd AS zd FROM te) SELECT term, "
    + ", ".join(f"""round(coef_{g}, 6) AS coef_{g}, round(sd_{g}, 6) AS sd_{g}, round(exp(coef_{g}), 6) AS or_{g}, round(exp(coef_{g} - {_Z} * sd_{g}), 6) AS
  or_lower_{g}, round(exp(coef_{g} + {_Z} * sd_{g}), 6) AS or_upper_{g}, round({_phi(f'z_{g}')}, 6) AS prob_positive_{g}""" for g in _GP)
    + f", round(diff, 6) AS diff, round(sd_diff, 6) AS sd_diff, round({_phi('zd')}, 6) AS prob_stronger FROM g",
)(lambda s, d: reports.group_posteriors(t := _terms(s, d), t.withColumn("coef", F.col("coef") * 2), "treatment"))
_query(
    "comparison_table",
    f"""WITH {SEQ},
te AS (SELECT subject AS term, avg((state < 3)::INT) AS p FROM seq GROUP BY 1),
f AS (SELECT *, avg(1 - p) OVER (ORDER BY p DESC, term ROWS UNBOUNDED PRECEDING) AS fdr FROM te)
SELECT term, round(p, 3) AS prob_direction, round(fdr, 3) AS fdr, fdr <= 0.2 AS credible, row_number() OVER (ORDER BY p DESC, term) AS place FROM f""",
)(lambda s, d: reports.comparison_table(v_seq(s, d).groupBy(F.col("subject").alias("term")).agg(F.avg((F.col("state") < 3).cast("int")).alias("prob_direction")), 0.2))
_query(
    "fold_table",
    f"""WITH {SEQ},
l AS (SELECT state::BIGINT AS term, grp, subject, avg(x) / 100 AS coef FROM seq GROUP BY 1, 2, 3),
m AS (SELECT term, avg(coef) FILTER (grp = 'a') AS mean_a, avg(coef) FILTER (grp = 'b') AS mean_b, stddev_samp(coef) FILTER (grp = 'a') AS sd_a,
  stddev_samp(coef) FILTER (grp = 'b') AS sd_b FROM l GROUP BY 1),
r AS (SELECT term, round(mean_a, 4) AS mean_a, round(sd_a, 4) AS sd_a, round(mean_b, 4) AS mean_b, round(sd_b, 4) AS sd_b, round(least(sd_a, sd_b) /
  greatest(sd_a, sd_b), 4) AS stability FROM m)
SELECT *, row_number() OVER (ORDER BY stability DESC NULLS LAST, term) AS place FROM r""",
)(lambda s, d: reports.fold_table(v_seq(s, d).groupBy(F.col("state").alias("term"), "grp", "subject").agg((F.avg("x") / 100).alias("coef"))))
_query(
    "split_half_interval",
    f"""WITH {OBS},
h AS (SELECT *, row_number() OVER w <= count(*) OVER (PARTITION BY state, feature) // 2 AS f FROM obs WINDOW w AS (PARTITION BY state, feature ORDER
  BY id)),
u AS (SELECT h.*, d, ('0x' || substr(md5(state || ':' || id || ':' || d || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, range(1, 101)
  r(d)),
w AS (SELECT *, {_WEIGHT} AS w FROM u),
m AS (SELECT state, d, feature, sum(w * value) FILTER (f) / sum(w) FILTER (f) AS x, sum(w * value) FILTER (NOT f) / sum(w) FILTER (NOT f) AS y FROM w
  GROUP BY 1, 2, 3),
c AS (SELECT state, d, greatest(0, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12))) AS c FROM m GROUP BY 1, 2)
SELECT state::BIGINT AS state, round(quantile_cont(c, 0.025), 6) AS ci_lower, round(quantile_cont(c, 0.975), 6) AS ci_upper, round(stddev_pop(c), 6)
  AS std FROM c GROUP BY 1""",
)(lambda s, d: patterns.split_half_interval(v_obs(s, d)))

# ranges, products, lookups and round trips
_query("agreement_range", f"WITH {_AG} SELECT bin::BIGINT AS bin, count, round(agreement, 6) AS agreement FROM ag WHERE bin >= 14 AND bin < 466")(lambda s, d: align.agreement(align.response_bins(v_rt(s, d), BIN), within=align.UNIT_RANGES["TR"]))
_FEATS = "f AS (SELECT t, (avg((state = 2)::INT) > 0.2)::BIGINT AS p, (avg((state = 0)::INT) > 0.2)::BIGINT AS q FROM seq GROUP BY 1)"


def _step_features(seq: DataFrame) -> DataFrame:
    share = lambda v: (F.avg((F.col("state") == v).cast("int")) > 0.2).cast("long")
    return seq.groupBy("t").agg(share(2).alias("p"), share(0).alias("q"))


_query("feature_products", f"WITH {SEQ}, {_FEATS} SELECT t, p, q, p * q AS p_q, q * p AS q_p FROM f")(lambda s, d: panel.feature_products(_step_features(v_seq(s, d)), [("p", "q"), ("q", "p")]))
_query(
    "design_products",
    f"""WITH {SEQ}, {_FEATS},
y AS (SELECT subject, grp, t, (state = 1)::BIGINT AS y, CASE grp WHEN 'b' THEN 0 ELSE 1 END::BIGINT AS g FROM seq)
SELECT subject, grp, t, y, lag(y, 1, 0) OVER w AS y_lag1, g AS group_coded, p, q, p * q AS p_q, g * p AS group_p_interaction, g * q AS
  group_q_interaction, g * p * q AS group_p_q_interaction FROM y JOIN f USING (t) WINDOW w AS (PARTITION BY subject ORDER BY t)""",
)(lambda s, d: panel.design_matrix(panel.target_indicator(x := v_seq(s, d), 1).select("subject", "grp", "t", "y"), _step_features(x), ["p", "q"], lags=1, coding="treatment", groups=("b", "a"), products=[("p", "q")]))
_query("fill_defaults", "SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS total, coalesce(max(o_orderstatus), 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda s, d: panel.fill_defaults(
        table(s, d, "customer").select("c_custkey").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderstatus").alias("status")), {"total": 0.0, "status": "none"}
    )
)
_query(
    "paired_series",
    f"""WITH {SEQ} SELECT 'sub-' || subject AS subject, grp, t, (state = CASE grp WHEN 'a' THEN 1 ELSE 3 END)::BIGINT AS y, round(avg((state = CASE grp WHEN
  'a' THEN 1 ELSE 3 END)::INT) OVER (PARTITION BY subject), 6) AS mean_occupancy FROM seq""",
)(lambda s, d: panel.paired_series({"a": v_seq(s, d), "b": v_seq(s, d)}, {"a": 1, "b": 3}))
_query("word_presence", f"""WITH {_AS} SELECT story, word_id, coalesce(contains(lower(actor), 'user') AND contains(lower(actor), 'assistant'), false) AS both_present,
  coalesce(contains(lower(actor), 'user'), false) AS user_present FROM asw""".replace("g.seg, g.speaker", "g.seg, g.actor, g.speaker"))(
    lambda s, d: align.word_flags(align.asof_segment(v_word(s, d), v_seg(s, d)), "user", {}, {"both_present": ("User", "assistant"), "user_present": ("user",)}).select("story", "word_id", "both_present", "user_present")
)


def _expected_bins(s: SparkSession, d: str) -> DataFrame:
    """Number of bins of each story from its turns' numbers of words, for the check of its own bins against them."""
    words = table(s, d, "conversations").groupBy(F.col("conv_id").alias("story")).agg(F.sum(F.size(F.split("text", " "))).alias("n"))
    return words.select("story", (bin_floor((F.col("n") - 1) * F.lit(0.4), 6.0) + 1).alias("size"))


_query(
    "bin_annotations",
    f"""WITH {_AS},
b AS (SELECT *, floor((onset - min(onset) OVER (PARTITION BY story)) / 6)::BIGINT AS bin FROM asw),
g AS (SELECT story, bin, avg(is_verb::INT) > 0.5 AS mostly_is_verb, max(is_verb) AS has_is_verb, sum(is_verb::INT)::BIGINT AS n_is_verb,
  string_agg(text, ' ' ORDER BY onset, word_id) AS words, coalesce(string_agg(text, ' ' ORDER BY onset, word_id) FILTER (is_verb), '') AS verbs,
  coalesce(string_agg(text, ' ' ORDER BY onset, word_id) FILTER (is_noun), '') AS nouns, arg_min(seg, word_id) AS segment_text FROM b GROUP BY 1, 2),
m AS (SELECT story, bin, arg_min(said_by, (-n, said_by)) AS said_by FROM (SELECT story, bin, said_by, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY
  1, 2),
a AS (SELECT story, bin, arg_min(actor, (-n, actor)) AS actor FROM (SELECT story, bin, actor, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT story, unnest(range(max(bin) + 1)) AS bin FROM g GROUP BY 1)
SELECT c.story, c.bin, coalesce(mostly_is_verb, false) AS mostly_is_verb, coalesce(has_is_verb, false) AS has_is_verb, coalesce(n_is_verb, 0) AS
  n_is_verb, coalesce(words, '') AS words, coalesce(verbs, 'none') AS verbs, coalesce(nouns, 'none') AS nouns, coalesce(segment_text, '') AS
  segment_text, coalesce(said_by, 'none') AS said_by, coalesce(actor, 'none') AS actor FROM c LEFT JOIN g ON g.story = c.story AND g.bin = c.bin LEFT
  JOIN m ON m.story = c.story AND m.bin = c.bin LEFT JOIN a ON a.story = c.story AND a.bin = c.bin""".replace("g.seg, g.speaker", "g.seg, g.actor, g.speaker"),
)(lambda s, d: align.dense_bins(align.bin_majority(_tagged(s, d), ["is_verb"], 6.0, lists={"verbs": "is_verb", "nouns": "is_noun"}, modes=("said_by", "actor")), _expected_bins(s, d)))
_query(
    "window_text_left",
    f"""WITH {_WIN} SELECT wi.story, round(begin, 6) AS begin, round(stop, 6) AS "end", string_agg(text, ' ' ORDER BY onset, word_id) AS text FROM wi JOIN w
  ON w.story = wi.story AND onset >= begin AND onset < stop GROUP BY 1, 2, 3""",
)(lambda s, d: align.events_to_text(v_word(s, d), _windows(s, d), closed="left", width=7.0))
_query("significant_features_fixed", f"WITH {_IV} SELECT pattern, feature FROM iv WHERE mean > 0.01 AND lo > 0.005")(lambda s, d: patterns.significant_features(_intervals(s, d), 0.01, fixed=0.005).select("pattern", "feature"))
_query(
    "state_stats_dense",
    f"""WITH {_SF},
c AS (SELECT DISTINCT feature, unnest(range(13)) AS state FROM sf)
SELECT c.state::BIGINT AS state, c.feature, coalesce(round(mean, 6), 0) AS mean, coalesce(round(std, 6), 0) AS std, coalesce(n, 0) AS n,
  coalesce(round(importance, 6), 0) AS importance FROM c LEFT JOIN si ON si.state = c.state AND si.feature = c.feature""",
)(lambda s, d: patterns.state_feature_stats(v_obs(s, d), k=13).drop("cv"))
_METRIC = """m AS (SELECT c_nationkey AS model, avg(c_acctbal) AS score FROM customer GROUP BY 1),
v AS (SELECT c_nationkey AS model, avg(o_totalprice) AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY
  1),
k AS (SELECT s_nationkey AS model, count(*) AS n_suppliers FROM supplier GROUP BY 1)"""


def _metric_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customer = table(s, d, "customer")
    score = customer.groupBy(F.col("c_nationkey").alias("model")).agg(F.avg("c_acctbal").alias("score"))
    open_ = table(s, d, "orders").filter("o_orderstatus = 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return score, open_.groupBy(F.col("c_nationkey").alias("model")).agg(F.avg("o_totalprice").alias("price")), table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.count("*").alias("n_suppliers"))


_query("complete_models", f"WITH {_METRIC} SELECT model::BIGINT AS model, round(score, 6) AS score, round(price, 6) AS price, n_suppliers FROM m JOIN v USING (model) JOIN k USING (model)")(lambda s, d: tables.complete(*_metric_tables(s, d), on=["model"]))
_query("metric_enrichment", f"WITH {_METRIC} SELECT model::BIGINT AS model, round(score, 6) AS score, round(price, 6) AS price, n_suppliers FROM m LEFT JOIN v USING (model) LEFT JOIN k USING (model)")(lambda s, d: tables.enriched(*_metric_tables(s, d), on=["model"]))
_query(
    "best_models",
    f"""WITH {MODELS},
b AS (SELECT model, score, spread, n FROM models)
SELECT 'score' AS metric, (SELECT model FROM b ORDER BY score DESC, model LIMIT 1)::BIGINT AS model, round(max(score), 6) AS value FROM b UNION ALL
  SELECT 'spread', (SELECT model FROM b ORDER BY spread, model LIMIT 1), round(min(spread), 6) FROM b UNION ALL SELECT 'n', (SELECT model FROM b ORDER
  BY n DESC, model LIMIT 1), max(n)::DOUBLE FROM b""",
)(lambda s, d: inference.best_models(v_models(s, d), {"score": True, "spread": False, "n": True}))
_query(
    "cluster_renumber",
    f"""WITH {_ME},
t AS (SELECT cluster, sum(occupancy) AS total, min(id) AS least FROM me GROUP BY 1),
p AS (SELECT cluster, row_number() OVER (ORDER BY round(total, 6) DESC, least) AS number FROM t)
SELECT id, cluster, number FROM me JOIN p USING (cluster)""",
)(lambda s, d: patterns.renumbered(_members(s, d)).select("id", "cluster", "number"))


def _member_lookup(s: SparkSession, d: str) -> DataFrame:
    """The members of the largest cluster from the first group's commonest model."""
    members = _members(s, d).withColumn("model", F.concat(F.lit("m"), (F.col("id") % 7).cast("string")))
    top = members.filter("grp = 'a'").groupBy("cluster", "model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster", "model").first()
    return patterns.find_member(members, top["cluster"], "a", top["model"]).select("id", "cluster", "model")


_query("member_lookup", f"""WITH {_ME},
x AS (SELECT id, cluster, grp, 'm' || id % 7 AS model FROM me),
t AS (SELECT cluster, model FROM x WHERE grp = 'a' GROUP BY 1, 2 ORDER BY count(*) DESC, cluster, model LIMIT 1)
SELECT id, x.cluster, x.model FROM x JOIN t ON t.cluster = x.cluster AND t.model = x.model WHERE grp = 'a'""")(_member_lookup)
_query(
    "top_interactions",
    f"WITH {SEQ} SELECT state::VARCHAR AS feature, round(avg((x > 100)::INT), 6) AS prob_positive FROM seq WHERE grp = 'b' GROUP BY 1 ORDER BY prob_positive DESC, feature LIMIT 3",
)(
    lambda s, d: inference.top_interactions(
        v_seq(s, d).withColumn("term", F.when(F.col("grp") == "a", "group_coded").otherwise(F.concat(F.lit("group_"), F.col("state").cast("string"), F.lit("_interaction")))).groupBy("term").agg(F.avg((F.col("x") > 100).cast("double")).alias("prob_positive")), 3
    )
)
_AGREE = "SELECT step, sum(n / al * ln(n * al / (nx * ny))) AS mi, any_value(al) AS al, sum(n * (n - 1) / 2) AS pc FROM {c} GROUP BY 1"
_ARI = "(pc - px * py / (al * (al - 1) / 2)) / nullif((px + py) / 2 - px * py / (al * (al - 1) / 2), 0)"
_TABLE = """SELECT step, x, y, n::DOUBLE AS n, sum(n) OVER (PARTITION BY step)::DOUBLE AS al, sum(n) OVER (PARTITION BY step, x)::DOUBLE AS nx, sum(n) OVER
  (PARTITION BY step, y)::DOUBLE AS ny FROM {of}"""
_SIDE = "SELECT step, -sum(m / al * ln(m / al)) AS h, sum(m * (m - 1) / 2) AS p FROM (SELECT step, {v}, sum(n) AS m, any_value(al) AS al FROM {c} GROUP BY 1, 2) GROUP BY 1"


def _agreed(name: str, of: str) -> str:
    """SQL of both measures from a table of label pairs by step."""
    return f"""{name}c AS ({_TABLE.format(of=of)}), {name}x AS ({_SIDE.format(v='x', c=name + 'c')}), {name}y AS ({_SIDE.format(v='y', c=name + 'c')}), {name}s AS
  ({_AGREE.format(c=name + 'c')}), {name} AS (SELECT s.step, {_ARI.replace('px', 'a.p').replace('py', 'b.p')} AS ari, mi / nullif((a.h + b.h) / 2, 0)
  AS nmi FROM {name}s s JOIN {name}x a ON a.step = s.step JOIN {name}y b ON b.step = s.step)"""


_query(
    "threshold_agreement",
    f"""WITH {_ASG},
i AS (SELECT DISTINCT id FROM asg),
dn AS (SELECT i.id, r.s AS step, cluster FROM i CROSS JOIN range(64) r(s) LEFT JOIN asg ON asg.id = i.id AND asg.i = r.s),
mv AS (SELECT a.step, a.cluster AS x, b.cluster AS y, count(*) AS n FROM dn a JOIN dn b ON b.id = a.id AND b.step = a.step + 1 GROUP BY 1, 2, 3),
kn AS (SELECT * FROM mv WHERE x IS NOT NULL AND y IS NOT NULL), {_agreed('co', 'kn')}, {_agreed('fu', 'mv')},
z AS (SELECT step, coalesce(sum(n) FILTER (x IS NOT NULL AND y IS NOT NULL), 0)::BIGINT AS common, coalesce(sum(n) FILTER (x IS NOT NULL AND y IS
  NULL), 0)::BIGINT AS lost, coalesce(sum(n) FILTER (x IS NULL AND y IS NOT NULL), 0)::BIGINT AS gained, coalesce(sum(n) FILTER (x IS NOT NULL),
  0)::BIGINT AS patterns1, coalesce(sum(n) FILTER (y IS NOT NULL), 0)::BIGINT AS patterns2, count(DISTINCT x) AS clusters1, count(DISTINCT y) AS
  clusters2 FROM mv GROUP BY 1)
SELECT round(z.step / 64.0::DOUBLE, 6) AS threshold1, round((z.step + 1) / 64.0::DOUBLE, 6) AS threshold2,
  round(coalesce(co.ari, CASE WHEN co.step IS NULL THEN 0 ELSE 1 END), 6) AS ari, round(coalesce(co.nmi, CASE WHEN co.step IS NULL THEN 0 ELSE 1 END),
  6) AS nmi, round(coalesce(fu.ari, 1), 6) AS ari_full, round(coalesce(fu.nmi, 1), 6) AS nmi_full, common, lost, gained, patterns1, patterns2,
  clusters1, clusters2 FROM z LEFT JOIN co ON co.step = z.step JOIN fu ON fu.step = z.step""",
)(lambda s, d: pairs.threshold_agreement(_assigned(s, d)))


def _mean_vectors(s: SparkSession, d: str) -> DataFrame:
    return v_obs(s, d).groupBy(F.col("state").alias("id"), "feature").agg(F.avg("value").alias("value"))


_query(
    "correlation_groups",
    f"""WITH {OBS},
m AS (SELECT state AS id, CASE WHEN state % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, feature, avg(value) AS v FROM obs GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0::DOUBLE AS r FROM m),
c AS (SELECT least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, corr(x.r, y.r) AS rho FROM r x JOIN r y ON x.feature = y.feature AND x.id < y.id
  GROUP BY x.id, y.id, x.grp, y.grp),
g AS (SELECT grp, feature, avg(v) AS v FROM m GROUP BY 1, 2),
q AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2.0::DOUBLE AS r FROM g),
b AS (SELECT x.grp AS a, y.grp AS b, corr(x.r, y.r) AS rho FROM q x JOIN q y ON x.feature = y.feature AND x.grp < y.grp GROUP BY 1, 2)
SELECT c.a, c.b, round(any_value(b.rho), 6) AS rho, round(avg(c.rho), 6) AS mean_rho, count(c.rho) AS n_pairs FROM c LEFT JOIN b ON b.a = c.a AND b.b
  = c.b GROUP BY 1, 2""",
)(lambda s, d: pairs.correlation_groups(x := _mean_vectors(s, d), x.select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("grp")).distinct()))


def _csv_scan(s: SparkSession, d: str) -> DataFrame:
    """The customers written as CSV with two note rows under each header, and read again."""
    path = f"{shared_dir(s).rstrip('/')}/scan-{uuid.uuid4().hex}"
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", F.col("c_acctbal").cast("string").alias("balance"), F.lit(1).alias("kind"))
    notes = s.range(2).select(F.lit("note").alias("id"), F.lit("n").alias("c_name"), F.lit("b").alias("balance"), F.lit(0).alias("kind"))
    rows.unionByName(notes).coalesce(1).sortWithinPartitions("kind").drop("kind").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    read = tables.read_csv_probed(s, path, "id string, c_name string, balance string", skip_rows=2)
    return read.select(F.col("id").cast("long").alias("c_custkey"), "c_name", F.col("balance").cast("double").alias("balance"))


_query("csv_scan", "SELECT c_custkey, c_name, round(c_acctbal, 6) AS balance FROM customer")(_csv_scan)


def _keyed_scan(s: SparkSession, d: str) -> DataFrame:
    """Orders written by status and read again with the key taken from the path."""
    path = f"{shared_dir(s).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    tables.write_stage(table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status")), path, "status")
    return tables.read_keyed(s, f"{path}/status=*", r"status=([^/]+)/", "status").select("o_orderkey", "o_custkey", "status")


_query("keyed_scan", "SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders")(_keyed_scan)
