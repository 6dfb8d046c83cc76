"""Merkle manifest of a table: one hash tree for each key, one over the keys, and inclusion proofs.

Leaves are hashed where the rows are read; after that only ids and digests move.
Places in a tree come from one range sort by key and order: the sorted parts'
share of a key are counted and laid end to end, so no key is one task.  A level
is one window over runs of `fan_out` neighbours: fixed-offset lag and lead
columns, masked by the slot in the run and the run's length, are a node's
siblings, and the first row of every run hashes its parent.  Each level is
written, a `fan_out`th of the one below.  Proofs go down again: a node's path is
its own slot and siblings followed by its parent's path, so the path of the
upper levels is made once for a run, not once for a leaf.

Defined cases: a null column is `-` in a leaf, which no value is; a null key is a
key of its own, before all others; ids may be repeated or null (first), equal
ids stand in the order of their leaves; equal rows are leaves of their own, side
by side; a text of any length is hashed where it is; a table of one row has its leaf as root
and an empty proof; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import numbered, written

#: Fixed value: columns that make a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the values end to end."""
    return F.sha2(F.concat(*columns), 256)


def leaf_of(*columns: Column) -> Column:
    """Digest of the values, each as its length in bytes, a colon and itself, or `-` where it is null."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, columns))


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, leaf, ...) -> the same with tree, slot and n (leaves of the tree), and the trees (tree, key, n)."""
    order = [F.col("key").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    sorted_parts = written(leaves.orderBy(*order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    sorted_parts = sorted_parts.withColumn("part", F.shiftright("at", 33))
    # a row for each part and key: what stands before it in its key
    pieces = sorted_parts.groupBy("part", "key").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = F.sum("here").over(W.partitionBy("key").orderBy("part")) - F.col("here")
    pieces = pieces.select("part", "key", "first", before.alias("before"))
    sizes = sorted_parts.groupBy("key").agg(F.count("*").alias("n"))
    trees = written(numbered(sizes, F.col("key").asc_nulls_first(), name="tree"))
    known = written(pieces.join(trees, pieces["key"].eqNullSafe(trees["key"])).select("part", "tree", "n", "first", "before", pieces["key"]).withColumnRenamed("key", "of"))
    out = sorted_parts.withColumnRenamed("part", "part_").join(known, (F.col("part_") == F.col("part")) & F.col("key").eqNullSafe(F.col("of")))
    return out.withColumn("slot", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "part_", "of", "first", "before"), trees


def _with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """(tree, slot, n, hash, ...) -> adds up (place of the parent), spot (place in the run), siblings (digests end to end) and parent (on the first of a run)."""
    up = F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.floor(F.col("slot") / fan_out)).cast("long")  # a tree's last node has none
    nodes = nodes.withColumn("up", up).withColumn("spot", F.pmod("slot", F.lit(fan_out)).cast("int"))
    length = F.when(F.col("n") == 1, 1).otherwise(F.least(F.lit(fan_out).cast("long"), F.col("n") - F.col("up") * fan_out))
    run = W.partitionBy("tree", "up").orderBy("slot")
    left = [F.when(F.col("spot") >= k, F.lag("hash", k).over(run)) for k in range(fan_out - 1, 0, -1)]
    right = [F.when(F.col("spot") + k < length, F.lead("hash", k).over(run)) for k in range(1, fan_out)]
    joined = nodes.withColumn("siblings", F.concat_ws("", *left, *right))
    return joined.withColumn("parent", F.when((F.col("spot") == 0) & (F.col("n") > 1), digest(F.col("hash"), F.col("siblings"))))


def _levels(leaves: DataFrame, most: int, fan_out: int) -> list[DataFrame]:
    """Nodes of every level above the leaves, (tree, slot, n, hash), written; `most` is the largest tree's number of leaves."""
    out, nodes = [], leaves
    while most > 1:
        up = _with_siblings(nodes, fan_out).filter(F.col("parent").isNotNull())
        nodes = written(up.select("tree", F.col("up").alias("slot"), F.ceil(F.col("n") / fan_out).cast("long").alias("n"), F.col("parent").alias("hash")))
        out.append(nodes)
        most = -(-most // fan_out)
    return out


def _paths(nodes: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """Nodes with their path to the root: their own spot and siblings, then those of (tree, up) in `above`."""
    own = F.array(F.struct("spot", "siblings"))
    held = _with_siblings(nodes, fan_out).join(above.hint("merge"), ["tree", "up"])
    return held.withColumn("path", F.when(F.col("n") == 1, F.col("path_above")).otherwise(F.concat(own, "path_above"))).drop("path_above", "spot", "siblings", "parent", "up")


def folded(leaf: Column, path: Column, width: int = 64) -> Column:
    """Root that a leaf and a path of (spot, siblings) lead to."""

    def step(node: Column, at: Column) -> Column:
        cut = at["spot"] * width
        return digest(F.substr(at["siblings"], F.lit(1), cut), node, F.substr(at["siblings"], cut + 1))

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, fan_out: int = 16, id_col: str = "doc_id", key_col: str = "source", leaf_columns: Sequence[str] = LEAF_COLUMNS, changed: Column | None = None) -> DataFrame:
    """One row per input row: id, leaf, subroot (of its key), root, path (array of spot and siblings) and changed_leaf.

    `path` is the inclusion proof, from the leaf via the subroot to the root.
    `changed_leaf` is the digest of the row with `changed` in place of its last leaf column
    (`changed` null: unchanged, its own leaf), for checking rows against the proof.
    """
    parts = [docs[c] for c in leaf_columns]
    leaf = leaf_of(*parts)
    other = leaf if changed is None else F.when(changed.isNull(), leaf).otherwise(leaf_of(*parts[:-1], changed))
    own = docs.select(docs[id_col].alias("id"), docs[key_col].alias("key"), leaf.alias("leaf"), other.alias("changed_leaf"))
    leaves, trees = _placed(written(own).withColumn("tie", F.monotonically_increasing_id()))
    leaves = written(leaves.select("tree", "slot", "n", F.col("leaf").alias("hash"), "id", "changed_leaf"))
    bare = leaves.select("tree", "slot", "n", "hash")

    most, n_trees = trees.agg(F.max("n"), F.count("*")).first()
    levels = [bare, *_levels(bare, most or 0, fan_out)]
    subroots = written(reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "hash") for x in levels]))

    # the tree over the keys: one tree, numbered 0, of the subroots in order
    heads = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("slot"), F.lit(n_trees).cast("long").alias("n"), "hash", F.col("hash").alias("subroot"))
    top = [heads, *_levels(heads, n_trees, fan_out)]
    kind = "array<struct<spot:int,siblings:string>>"
    start = top[-1].select("tree", F.lit(-1).cast("long").alias("up"), F.array().cast(kind).alias("path_above"), F.col("hash").alias("root"))
    for nodes in reversed(top):
        made = written(_paths(nodes, start, fan_out))
        start = made.select("tree", F.col("slot").alias("up"), F.col("path").alias("path_above"), "root")
    heads = made.select(F.col("slot").alias("tree"), F.lit(-1).cast("long").alias("up"), F.col("path").alias("path_above"), "root", "subroot")

    above = heads
    for nodes in reversed(levels[1:]):
        made = written(_paths(nodes, above, fan_out))
        above = heads.unionByName(made.select("tree", F.col("slot").alias("up"), F.col("path").alias("path_above"), "root", "subroot"))
    out = _paths(leaves, above, fan_out)
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", "changed_leaf")
