"""Mixing sources to target weights, DataFrame functions only.

The words of a source, documents end to end in hash order, are packed into
blocks of a fixed length.  A source's target is a whole number of block slots.
Source counts of the output shards are multinomial draws given the sources'
totals: the slots of all sources are one deck, a keyed pseudorandom permutation
shuffles it, and a shard takes the next part of the shuffled deck.  (Free
multinomial draws would leave a source of n slots sqrt(n) of them off its
target, 11 % at 80 slots.)  Slot k of a source reads, in pass k div n, the block
at place k mod n of a permutation of the source's n blocks that is keyed by
source and pass.  Slots and blocks meet in a join on block index.

A source may hold any share of the rows and sources may be many: offsets are
prefix sums over hash ranges, sources are numbered by a distributed sort, and
block numbers, not source names, are the join keys.

Defined cases: null text has size 0 and takes no words; a null source is a
source of its own, last in order; repeated rows each get their own words; an
empty table gives an empty result; other columns, whatever their names, are not
read (`apply_mix` hands them on).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import free_names, numbered, spread_key, spread_of, written

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

_CHUNK = 1 << 12
_ROUNDS = 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3) -> DataFrame:
    """(key, source, source_size) -> adds `target`: shares of all words by weight, none above `most_passes` times its source.

    Sources by code point, null last, take the weights in turn.  The shares
    are a water level: a source whose limit is under the level times its weight
    is full, and what the full ones leave raises the level of the others, until
    no further one is full.  Each step is one aggregation over the sources.
    """
    placed = numbered(sizes, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    known = written(placed.select("key", "source", "source_size", weight.alias("weight"), (F.lit(float(most_passes)) * F.col("source_size")).alias("limit")))
    level, full = -1.0, -1
    while True:
        is_full = F.col("limit") <= F.lit(level) * F.col("weight")
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0))
        row = known.agg(F.count(F.when(is_full, 1)).alias("full"), F.try_divide(left, F.sum(F.when(~is_full, F.col("weight")))).alias("level")).first()
        if row["full"] == full or row["level"] is None:
            break
        level, full = row["level"], row["full"]
    return known.select("key", "source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *salt: Column, rounds: int = _ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1: each round swaps a pair i <-> shift-i or leaves both."""

    def turn(i: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("shift"), *salt), n) - i, n)
        flip = F.xxhash64(r, F.greatest(i, other), *salt).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, other).otherwise(i)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


@dataclass
class _Plan:
    """`rows` of documents with the place `from`..`to` of their words in their source, `sources`, and `slots` (key, block, pass, shard, slot)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame


def _plan(docs: DataFrame, weights, most_passes: int, block_words: int, shards: int, seed: int, id_col: str, text_col: str, source_col: str, extra: dict[str, Column]) -> _Plan:
    ranges = spread_of(docs.sparkSession)
    source = docs[source_col].cast("string")
    raw = docs[text_col].cast("binary")
    rows = docs.select(
        docs[id_col].alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("tie"),
        *[c.alias(n) for n, c in extra.items()],
    ).withColumn("range", spread_key("id", "tie", ranges=ranges))
    rows = written(rows)

    by_range = rows.groupBy("key", "source", "range").agg(F.sum("size").alias("part"))
    base = by_range.select("key", "range", (F.sum("part").over(W.partitionBy("key").orderBy("range")) - F.col("part")).alias("base"))
    sizes = by_range.groupBy("key", "source").agg(F.sum("part").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), blocks * most_passes)).otherwise(0)
    targets = source_targets(sizes, weights, most_passes).withColumn("blocks", blocks).withColumn("slots", wanted.cast("long"))
    # the deck: sources in order of a hash range, each range's slots end to end
    targets = written(targets.withColumn("range", spread_key("key", ranges=ranges)))
    totals = targets.groupBy("range").agg(F.sum("slots").alias("part"))
    starts = totals.select("range", (F.sum("part").over(W.orderBy("range")) - F.col("part")).alias("start"), F.sum("part").over(W.partitionBy()).alias("deck"))  # a row for each range
    inside = W.partitionBy("range").orderBy("key")
    sources = targets.join(starts, "range").withColumn("first", F.col("start") + F.sum("slots").over(inside) - F.col("slots")).drop("range", "start")

    chunks = sources.filter("slots > 0").select("key", "blocks", "slots", "first", "deck", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(_CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(ranges, "key", "chunk")
    slots = chunks.select("key", "blocks", "first", "deck", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + _CHUNK, F.col("slots")) - 1)).alias("k"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    at = permuted(F.col("first") + F.col("k"), F.col("deck"), F.lit(seed), F.lit("deck"))
    slots = slots.select("key", permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.col("key"), turn).alias("block"), turn.alias("pass"), "deck", at.alias("at"))
    shard = F.floor(F.col("at") * shards / F.col("deck"))
    slots = slots.select("key", "block", "pass", shard.cast("int").alias("shard"), (F.col("at") - F.ceil(shard * F.col("deck") / shards)).cast("long").alias("slot"))

    own = W.partitionBy("key", "range").orderBy("id", "size", "tie")
    placed = (
        rows.join(base, ["key", "range"])
        .withColumn("row", F.row_number().over(own))
        .withColumn("from", F.col("base") + F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("to", F.col("from") + F.col("size"))
    )
    return _Plan(placed, sources, slots)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, block_words: int = 128, shards: int = 16, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies.

    `taken` counts the words of the row in the blocks that the mix takes,
    repeats included; `copies` is taken / size rounded up or down by a hash of
    the row, so that whole documents follow the drawn words (1 for a row
    without words).
    """
    plan = _plan(docs, weights, most_passes, block_words, shards, seed, id_col, text_col, source_col, {})
    return _taken(plan, block_words, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def _taken(plan: _Plan, block_words: int, seed: int) -> DataFrame:
    drawn = plan.slots.groupBy("key", "block").agg(F.count("*").alias("times"))
    first_block = F.floor(F.col("from") / block_words)
    blocks = F.when(F.col("size") > 0, F.sequence(first_block, F.floor((F.col("to") - 1) / block_words))).otherwise(F.array(F.lit(-1).cast("long")))
    pieces = plan.rows.withColumn("block", F.explode(blocks))
    overlap = F.least("to", (F.col("block") + 1) * block_words) - F.greatest("from", F.col("block") * block_words)
    out = (
        pieces.join(drawn.hint("merge"), ["key", "block"], "left")  # both sides grow with the words: never broadcast
        .groupBy("key", "range", "row", "id", "size", "tie")
        .agg(F.sum(F.when(F.col("size") > 0, overlap * F.coalesce("times", F.lit(0))).otherwise(0)).cast("long").alias("taken"))
    )
    part = F.pmod(F.xxhash64(F.lit(seed), "key", "range", "row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + part)).otherwise(1).cast("long")
    return out.withColumn("copies", copies).join(plan.sources.select("key", "source_size", "target"), "key")


def mixed_blocks(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, block_words: int = 128, shards: int = 16, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: shard, slot (gapless from 0 in a shard), source, block, pass, n_words, text (the block's words, joined by blanks).

    Every block has `block_words` words but the last of its source.
    """
    plan = _plan(docs, weights, most_passes, block_words, shards, seed, id_col, text_col, source_col, {"text": docs[text_col]})
    first_block, last_block = F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words)
    words = plan.rows.filter("size > 0").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    pieces = words.select("key", "source", "from", "to", "words", F.explode(F.sequence(first_block, last_block)).alias("block"))
    begin = F.greatest("from", F.col("block") * block_words)
    piece = F.slice("words", (begin - F.col("from") + 1).cast("int"), (F.least("to", (F.col("block") + 1) * block_words) - begin).cast("int"))
    packed = pieces.groupBy("key", "source", "block").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), piece.alias("words")))).alias("pieces"))
    whole = F.flatten(F.transform("pieces", lambda p: p["words"]))
    packed = packed.select("key", "source", "block", F.size(whole).alias("n_words"), F.array_join(whole, " ").alias("text"))
    return plan.slots.hint("merge").join(packed, ["key", "block"]).select("shard", "slot", "source", "block", "pass", "n_words", "text")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns unchanged, each as often as the mix takes it (0 to most_passes times).

    Rows of one id and text that stand several times share their copies.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    own, tie, source, n, place = free_names(docs, "id", "tie", "source", "copies", "n")
    source_col = options.get("source_col", "source")
    crc = F.coalesce(F.crc32(docs[text_col].cast("binary")), F.lit(0))
    options = {k: options.get(k, v) for k, v in {"weights": (1, 2, 3), "most_passes": 3, "block_words": 128, "shards": 16, "seed": 17}.items()}
    plan = _plan(docs, *options.values(), id_col, text_col, source_col, {})
    taken = _taken(plan, options["block_words"], options["seed"])
    copies = taken.groupBy(F.col("id").alias(own), F.col("tie").alias(tie), F.col("key").alias(source)).agg(F.array_sort(F.collect_list("copies")).alias(n)).filter(F.exists(n, lambda c: c > 0))
    key = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    met = docs.join(copies.hint("merge"), docs[id_col].eqNullSafe(F.col(own)) & (crc == F.col(tie)) & (key == F.col(source)))
    # rows that share id, text and source take the entries of the list in turn
    single = met.filter(F.size(n) == 1).withColumn(place, F.col(n)[0])
    several = met.filter(F.size(n) > 1).withColumn(place, F.element_at(n, F.row_number().over(W.partitionBy(own, tie, source).orderBy(own)).cast("int")))
    both = single.unionByName(several)
    return both.withColumn(place, F.explode(F.when(F.col(place) > 0, F.sequence(F.lit(1).cast("long"), F.col(place))))).select(*docs.columns)
