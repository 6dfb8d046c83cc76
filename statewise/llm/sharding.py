"""Best-fit-decreasing sharding of indivisible groups.

Groups of equal texts, largest first, enter the shard with the tightest
remaining capacity that still holds them.  Groups of one size class are placed
together, which gives the same packing as one by one, so what the packing reads
is a histogram of size classes: sizes up to 4096 and from 1/64 of the capacity
are exact, those between are rounded up to 9 significant bits, fewer than 32,000
classes for any input besides at most 64 exact ones for each capacity filled.  Open
shards stand in a balanced tree by remaining capacity.  Each group then finds
its shard from its rank in its class.

A group that is larger than a shard cannot stay whole; it is cut into pieces of
whole documents that fill a shard each, and the rest piece.

Defined cases: null text has no bytes (size 1, crc 0) and is a group of its
own; repeated rows are members like any other; an empty table gives an empty
result; a document larger than a shard stands alone; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import spread_key, spread_of, written

_BITS, _SHARE = 9, 64


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.rank, self.left, self.right = key, crc32(b"%d:%d" % key), None, None


class OpenShards:
    """Balanced tree (a treap) of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, right = self._split(node.right, key)
            return node, right
        left, node.left = self._split(node.left, key)
        return left, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, _Node(key)), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest remaining capacity of at least `size`."""
        left, right = self._split(self.root, (size, -1))
        node = right
        while node is not None and node.left is not None:
            node = node.left
        if node is None:
            self.root = self._join(left, right)
            return None
        _, rest = self._split(right, (node.key[0], node.key[1] + 1))
        self.root = self._join(left, rest)
        return node.key

    def roomiest(self) -> tuple[int, int] | None:
        node = self.root
        while node is not None and node.right is not None:
            node = node.right
        if node is None:
            return None
        self.root, _ = self._split(self.root, node.key)
        return node.key


@dataclass(frozen=True)
class Run:
    """Groups `first` .. `first + count - 1` of a size class go to `shard`."""

    size: int
    first: int
    count: int
    shard: int


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most_shards: int | None = None) -> list[Run]:
    """Pack `count` groups of each `size`.  With `most_shards` open and none fitting, the roomiest takes the group beyond its capacity."""
    shards, opened, runs = OpenShards(), 0, []
    for size, count in sorted(histogram, reverse=True):
        placed = 0
        while placed < count:
            at = shards.take(size)
            if at is None and (most_shards is None or opened < most_shards):
                at, opened = (max(capacity, size), opened), opened + 1
            over = at is None
            if over:
                at = shards.roomiest()
            remaining, shard = at
            n = 1 if over else min(count - placed, remaining // max(size, 1))
            runs.append(Run(size, placed, n, shard))
            placed += n
            shards.add((remaining - n * size, shard))
    merged: list[Run] = []
    for r in runs:
        last = merged[-1] if merged else None
        if last and last.size == r.size and last.shard == r.shard and last.first + last.count == r.first:
            merged[-1] = Run(r.size, last.first, last.count + r.count, r.shard)
        else:
            merged.append(r)
    return merged


def _class_of(size, capacity: int):
    """Column: `size`, rounded up to 9 significant bits above 4096 and below 1/64 of the capacity."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - (_BITS - 1), F.lit(0))).cast("long")
    return F.when((size <= 4096) | (size * _SHARE >= capacity), size).otherwise(F.ceil(size / step) * step).cast("long")


def _as_of(ranked: DataFrame, runs: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """`ranked` (key, rank, ...) with the shard of the run (key, from, to, shard) that holds each rank.

    Runs are laid over buckets of `width` ranks, so a key with any number of
    runs and ranks is many small groups; in each the run in force is carried
    forward from its first rank.
    """
    first, last = F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width)
    starts = runs.select(key, "from", "shard", F.explode(F.sequence(first, last)).alias("bucket")).select(key, "bucket", F.greatest("from", F.col("bucket") * width).alias("rank"), "shard")
    rows = ranked.withColumns({"bucket": F.floor(F.col("rank") / width), "held": F.lit(True)})
    both = rows.unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy(key, "bucket").orderBy("rank", F.col("held").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("shard", F.last("shard", True).over(order)).filter("held").drop("bucket", "held")


def shard_groups(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, group_rows.

    Give `shards` (capacity is then an equal part of all bytes) or `capacity`
    with shards=None (as few shards as the packing needs).  The driver holds
    the runs of the packing: some rows for each shard and size class, no more.
    """
    spark = docs.sparkSession
    ranges = spread_of(spark)
    raw = docs[text_col].cast("binary")
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("crc"),
        F.coalesce(F.unhex(F.md5(raw)), F.lit(b"")).alias("group"),
    ).withColumn("range", spread_key("id", "crc", ranges=ranges))
    rows = written(rows)
    groups = written(rows.groupBy("group").agg(F.count("*").alias("n"), F.max("size").alias("size")))

    all_rows, exact = groups.select(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    limit = capacity or max(1, -(-(exact or 0) // shards))
    # at most exact/limit groups exceed a shard: that many rows come to the driver
    large = groups.filter(F.col("n") * F.col("size") > limit)
    small = groups.filter(F.col("n") * F.col("size") <= limit).withColumn("class", _class_of(F.col("n") * F.col("size"), limit))
    counted = {r["class"]: r["count"] for r in small.groupBy("class").count().toLocalIterator()}
    pieces = []  # (bytes, group, first row, rows)
    for r in large.toLocalIterator():
        per = max(1, limit // r["size"])
        pieces += [(min(per, r["n"] - at) * r["size"], bytes(r["group"]), at, min(per, r["n"] - at)) for at in range(0, r["n"], per)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    shift: dict[int, int] = {}  # pieces take the first ranks of their class
    for p in pieces:
        shift[p[0]] = shift.get(p[0], 0) + 1
    merged = {size: counted.get(size, 0) + shift.get(size, 0) for size in counted.keys() | shift.keys()}
    room = capacity or max(1, -(-sum(s * n for s, n in merged.items()) // shards))
    runs = best_fit_decreasing(list(merged.items()), room, shards)

    piece_rows, at = [], 0
    for run in runs:  # both lists fall by size
        n_pieces = min(run.count, max(0, shift.get(run.size, 0) - run.first))
        piece_rows += [(g, first, first + n, run.shard) for _, g, first, n in pieces[at : at + n_pieces]]
        at += n_pieces
    run_table = spark.createDataFrame([(r.size, r.first, r.first + r.count, r.shard) for r in runs], "class long, from long, to long, shard int")
    shifts = spark.createDataFrame(list(shift.items()), "class long, shift long")

    # rank of a group in its class, by hash ranges
    ranked = small.withColumn("range", spread_key("group", ranges=ranges))
    counts = ranked.groupBy("class", "range").count()
    base = counts.select("class", "range", (F.sum("count").over(W.partitionBy("class").orderBy("range")) - F.col("count")).alias("base"))
    rank = F.col("base") + F.row_number().over(W.partitionBy("class", "range").orderBy("group")) - 1 + F.coalesce("shift", F.lit(0))
    ranked = ranked.join(base, ["class", "range"]).join(shifts, "class", "left").withColumn("rank", rank).select("group", "n", "class", "rank")
    home = written(_as_of(ranked, run_table, "class").select("group", "n", "shard"))
    # groups of a thousandth of all rows or more are at most a thousand: their rows stay where they are
    common = F.broadcast(home.filter(F.col("n") * 1000 >= F.lit(all_rows or 0)))
    placed = rows.join(common, "group").unionByName(rows.join(F.broadcast(common.select("group")), "group", "left_anti").join(home, "group"))
    placed = placed.select("id", "size", "crc", "range", "n", "shard")

    if piece_rows:
        own = W.partitionBy("group")
        inside = rows.join(spark.createDataFrame([(g,) for g in {p[0] for p in piece_rows}], "group binary"), "group")
        counts = inside.groupBy("group", "range").count()
        base = counts.select("group", "range", (F.sum("count").over(own.orderBy("range")) - F.col("count")).alias("base"), F.sum("count").over(own).alias("n"))
        rank = F.col("base") + F.row_number().over(W.partitionBy("group", "range").orderBy("id")) - 1
        inside = inside.join(base, ["group", "range"]).withColumn("rank", rank)
        cut = _as_of(inside, spark.createDataFrame(piece_rows, "group binary, from long, to long, shard int"), "group")
        placed = placed.unionByName(cut.select("id", "size", "crc", "range", "n", "shard"))

    placed = written(placed)
    counts = placed.groupBy("shard", "range").count()
    base = counts.select("shard", "range", (F.sum("count").over(W.partitionBy("shard").orderBy("range")) - F.col("count")).alias("base"))
    slot = F.col("base") + F.row_number().over(W.partitionBy("shard", "range").orderBy("id", "crc")) - 1
    return placed.join(base, ["shard", "range"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("n").alias("group_rows")
    )
