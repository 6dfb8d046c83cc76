"""The long tables that the registered queries read, as views of the given tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ["click", "error", "purchase", "signup", "view"]
K, BIN, WIDTH = len(STATES), 21600.0, 64  # WIDTH: components of a vector


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200


def v_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of every user, series of unequal length."""
    # named before the window, and all else made after it: later windows and groups by subject stay in its partitions
    e = table(spark, sf, "events").select(F.col("user_id").alias("subject"), "ts", "event_id", "event_type", "value")
    placed = e.withColumn("t", F.row_number().over(W.partitionBy("subject").orderBy("ts", "event_id")) - 1)
    state = (F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type")) - 1).cast("int").alias("state")
    grp = F.when(F.col("subject") % 2 == 0, "a").otherwise("b").alias("grp")
    return placed.select("subject", "t", state, grp, F.col("value").alias("x"))


def v_rt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("participant"), seconds().alias("rt"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with their number of words and `first`, the number of their first word in the conversation: numbers of words summed over turns, no window over words."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.when(F.col("text").isNotNull(), F.size(F.split("text", " "))).otherwise(0).alias("n_words"))
    n = F.col("n_words")
    own = W.partitionBy("conv_id").orderBy("turn")
    return c.withColumns({"first": F.sum(n).over(own.rowsBetween(W.unboundedPreceding, 0)) - n, "before": F.lag("role").over(own)})


def v_word(spark: SparkSession, sf: str) -> DataFrame:
    c = _turns(spark, sf).select("conv_id", "turn", "role", "first", F.posexplode(F.split("text", " ")).alias("pos_in_turn", "text"))
    tag = F.get(F.array(*map(F.lit, ["noun", "verb", "adj", "adv", "other"])), F.length("text") % 5)
    c = c.withColumn("word_id", (F.col("first") + F.col("pos_in_turn")).cast("int"))
    return c.select(F.col("conv_id").alias("story"), "turn", F.col("role").alias("said_by"), "word_id", (F.col("word_id") * F.lit(0.4)).alias("onset"), "text", tag.alias("pos"))


def v_seg(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a story, from their first word on; `actor` names who speaks in the turn and in the one before."""
    actor = F.concat_ws(",", "before", "role").alias("actor")
    c = _turns(spark, sf).filter("text is not null and turn is not null and conv_id is not null").withColumn("onset_sec", F.col("first").cast("int") * F.lit(0.4))
    return c.select(F.col("conv_id").alias("story"), F.col("turn").alias("seg_id"), "onset_sec", F.col("role").alias("speaker"), F.col("text").alias("seg"), actor)


def v_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Every component of every vector."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("state"), F.posexplode("embedding").alias("feature", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


def v_atlas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("element"), F.col("p_brand").alias("parcel"), F.col("p_type").alias("network"))


def v_signal(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("element"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("value"))
    return li.join(v_atlas(spark, sf), "element")


def v_models(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("model")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("score"), F.stddev_pop("c_acctbal").alias("spread"), (F.col("c_nationkey") % 10 + 2).alias("k"))


SEQ = f"""seq AS (SELECT subject, t, state, grp, x FROM (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  list_position(['click','error','purchase','signup','view'], event_type) - 1 AS state, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, value AS x FROM events)),
chg AS (SELECT *, coalesce(state <> lag(state) OVER (PARTITION BY subject ORDER BY t), true)::INT AS c, lag(state) OVER (PARTITION BY subject ORDER BY t) AS prev FROM seq),
runs AS (SELECT subject, run, any_value(state) AS state, min(t) AS start, count(*) AS length, count(*) * 1.5::DOUBLE AS duration
  FROM (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY t) AS run FROM chg) GROUP BY subject, run),
st AS (SELECT unnest(range({K})) AS state)"""
RT = """rt AS (SELECT user_id AS participant, epoch(ts) - 1704067200 AS rt FROM events WHERE event_type = 'error'),
resp AS (SELECT DISTINCT participant, round_even(rt / 21600, 0)::INT AS bin FROM rt)"""
WORD = """word AS (SELECT conv_id AS story, turn, role AS said_by, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS word_id, text, i FROM
  (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)),
w AS (SELECT story, turn, said_by, word_id, word_id * 0.4::DOUBLE AS onset, text, (['noun','verb','adj','adv','other'])[length(text) % 5 + 1] AS pos FROM word),
act AS (SELECT conv_id, turn, concat_ws(',', lag(role) OVER (PARTITION BY conv_id ORDER BY turn), role) AS actor FROM conversations),
seg AS (SELECT w.story, w.turn AS seg_id, min(onset) AS onset_sec, any_value(role) AS speaker, any_value(c.text) AS seg, any_value(act.actor) AS actor FROM w JOIN conversations c ON c.conv_id = w.story AND c.turn = w.turn JOIN act ON act.conv_id = w.story AND act.turn = w.turn GROUP BY 1, 2)"""
OBS = "obs AS (SELECT vec_id AS id, label AS state, unnest(range(len(embedding))) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"
SIGNAL = "sig AS (SELECT l_suppkey AS subject, l_partkey AS element, p_brand AS parcel, p_type AS network, l_linenumber AS t, l_quantity AS value FROM lineitem JOIN part ON p_partkey = l_partkey)"
MODELS = "models AS (SELECT c_nationkey AS model, count(*) AS n, avg(c_acctbal) AS score, stddev_pop(c_acctbal) AS spread, c_nationkey % 10 + 2 AS k FROM customer GROUP BY c_nationkey)"
