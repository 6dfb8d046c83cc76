"""Preference formatting of paired conversations.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows on each side is its completion, with
the character spans on which a loss is taken (the text and end mark of the
assistant's turns).

Defined cases: turns are taken in order of turn number, then role and text; a
null role is rendered as "unknown", a null text as empty; a side without turns
has an empty completion; equal sides leave both completions empty; turns with a
null id are one pair; ids may be of any type and come back as they are (only
whole numbers, also written ones, have a next conversation); repeated turns are
turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: The marks around a turn.
HEAD, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


CHOSEN, REJECTED = 0, 1


def _numbered(chosen: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of both sides in sorted parts, written, and for each part and side of a pair in it: how many turns and code points of the side lie in earlier parts."""
    side = lambda df, n: df.select(F.struct("pair_id").alias("pair"), F.lit(n).alias("side"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a struct is equal to itself with a null inside, so joins, windows and groups share one partitioning
    both = side(chosen, CHOSEN).unionByName(side(rejected, REJECTED))
    # parts are cut by the short columns, texts only settle ties inside a part
    keys = ["pair", "side", "turn", "role"]
    placed = written(both.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").withColumn("at", F.monotonically_increasing_id()))
    width = F.length("role") + F.length("text") + F.lit(len(HEAD) + len(AFTER_ROLE) + len(END))
    turns = placed.withColumns({"part": F.shiftright("at", 33), "width": width.cast("long")})
    earlier = W.partitionBy("pair", "side").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    heads = turns.groupBy("part", "side", "pair").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("width").alias("wide"))
    zero = F.lit(0).cast("long")
    return turns, written(heads.select("part", "side", "pair", "first", F.coalesce(F.sum("n").over(earlier), zero).alias("turns_ahead"), F.coalesce(F.sum("wide").over(earlier), zero).alias("wide_ahead")))


def _placed(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """`turns` with `place` on its side and `before`, the code points rendered ahead of it there; a key is a side of a pair in one part, so no larger than a part."""
    joined = turns.join(heads, ["part", "side", "pair"])
    inside = W.partitionBy("part", "side", "pair").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumns({"place": F.col("at") - F.col("first") + F.col("turns_ahead"), "before": F.sum("width").over(inside) - F.col("width") + F.col("wide_ahead")})


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, role, text) of both sides -> one row per rendered turn: pair_id, section, place, rendered, start, end.

    Section is "prompt" (the common turns, once), "chosen" or "rejected"; place
    counts a side's turns from 0; start and end are the code points of an
    assistant's text and end mark in its completion (null elsewhere).  A
    conversation is cut at the parts of one sorted order: its turns are numbered
    and measured by prefix sums over parts, the first turn that differs is the
    least over (pair, place) groups of two, and no task holds a whole side.
    """
    turns, heads = _numbered(chosen, rejected)
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")), 256).alias("digest")
    narrow = _placed(turns.select("part", "side", "pair", "at", "width", digest), heads)
    met = narrow.groupBy("pair", "place").agg(((F.count("*") == 2) & (F.min("digest") == F.max("digest"))).alias("same"), F.min("before").alias("before"))
    parting = met.groupBy("pair").agg(F.min(F.when(~F.col("same"), F.struct("place", "before"))).alias("p")).select("pair", F.col("p.place").alias("parting"), F.col("p.before").alias("prompt_width"))
    # no differing turn: everything is prompt
    known = heads.join(parting, "pair", "left")
    rows = _placed(turns, known)
    common = F.col("parting").isNull() | (F.col("place") < F.col("parting"))
    start = F.col("before") - F.col("prompt_width") + F.lit(len(HEAD) + len(AFTER_ROLE)) + F.length("role")
    masked = ~common & (F.col("role") == ASSISTANT)
    section = F.when(common, "prompt").when(F.col("side") == CHOSEN, "chosen").otherwise("rejected")
    return rows.filter(~common | (F.col("side") == CHOSEN)).select(
        "pair.pair_id", section.alias("section"), "place", F.concat(F.lit(HEAD), "role", F.lit(AFTER_ROLE), "text", F.lit(END)).alias("rendered"),
        F.when(masked, start).alias("start"), F.when(masked, start + F.length("text") + F.lit(len(END) - 1)).alias("end"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, role, text) of both sides -> one row per pair, put together from `preference_turns`.

    pair_id, n_common, n_chosen, n_rejected (turns), prompt, chosen, rejected,
    chosen_mask, rejected_mask (spans start:end in the completion; the line
    break after an end mark is not in them).  A pair's row holds its rendered
    turns once; conversations beyond what a row can hold stay in the long form.
    """
    turns = preference_turns(chosen, rejected)
    held = lambda name: F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("place", "rendered", "start", "end")))).alias(f"{name}_turns")
    rows = turns.groupBy("pair_id").agg(held("prompt"), held("chosen"), held("rejected"))
    text = lambda name: F.array_join(F.transform(f"{name}_turns", lambda x: x["rendered"]), "").alias(name)
    spans = lambda name: F.transform(F.filter(f"{name}_turns", lambda x: x["start"].isNotNull()), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return rows.select(
        "pair_id", F.size("prompt_turns").alias("n_common"), F.size("chosen_turns").alias("n_chosen"), F.size("rejected_turns").alias("n_rejected"),
        text("prompt"), text("chosen"), text("rejected"),
        F.array_join(spans("chosen"), ",").alias("chosen_mask"), F.array_join(spans("rejected"), ",").alias("rejected_mask"),
    )


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from logged conversations (conv_id, turn, role, text).

    Chosen is the conversation up to its last assistant turn; rejected is the
    same with that turn's text replaced by the first assistant text of the
    conversation with the next number.  Without such a conversation the
    rejected side ends before the reply; without an assistant turn both sides
    are the whole conversation.
    """
    own = conversations["conv_id"]
    said = conversations.select(own.alias("pair_id"), own.try_cast("long").alias("number"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = said.filter(F.col("role") == ASSISTANT).groupBy("pair_id", "number").agg(F.max("turn").alias("last"), F.min_by(F.coalesce("text", F.lit("")), F.struct("turn", "text")).alias("reply"))
    other = last.filter("number is not null").groupBy((F.col("number") - 1).alias("number")).agg(F.min("reply").alias("other"))
    known = last.join(other, "number", "left").select(F.col("pair_id").alias("known_id"), "last", "other")
    turns = said.join(known, F.col("pair_id").eqNullSafe(F.col("known_id")), "left")
    chosen = turns.filter(F.coalesce(F.col("turn") <= F.col("last"), F.lit(True))).select("pair_id", "turn", "role", "text")
    is_reply = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT), F.lit(False))
    rejected = turns.filter(F.coalesce(F.col("turn") <= F.col("last"), F.lit(True)) & ~(is_reply & F.col("other").isNull()))
    return chosen, rejected.select("pair_id", "turn", "role", F.when(is_reply, F.col("other")).otherwise(F.col("text")).alias("text"))
