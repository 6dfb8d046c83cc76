"""Words and segments are numbered by sums over turns: no window sorts the words."""

from pyspark.sql import functions as F

from statewise.plans import views

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_make_no_words(spark):
    assert "Generate" not in _plan(views.v_seg(spark, SF))
    plan = _plan(views.v_word(spark, SF))
    assert "Generate" in plan.split("Window")[0] and plan.count("Window [") == 1  # one window, under the words


def test_words_are_numbered_through_the_turns(spark, tmp_path):
    rows = [(1, 0, "user", "a b c"), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "user", "d  e"), (2, 5, "user", "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    words = [(r["story"], r["turn"], r["word_id"], r["text"]) for r in views.v_word(spark, str(tmp_path)).orderBy("story", "word_id").collect()]
    assert words == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 2, 3, ""), (1, 3, 4, "d"), (1, 3, 5, ""), (1, 3, 6, "e"), (2, 5, 0, "f")]
    segments = {(r["story"], r["seg_id"]): (round(r["onset_sec"], 6), r["actor"]) for r in views.v_seg(spark, str(tmp_path)).collect()}
    assert segments == {(1, 0): (0.0, "user"), (1, 2): (1.2, "assistant,user"), (1, 3): (1.6, "user,user"), (2, 5): (0.0, "user")}
    assert views.v_word(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 8
