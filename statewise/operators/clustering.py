"""Average-linkage clustering of binary patterns by rounds of reciprocal nearest neighbours, and clusters over thresholds.

Equal patterns are one item with a weight.  Only clusters that a pair of similar
members links are held, with the sum of their known members' similarities, which
merging adds up.  In a round every two clusters that are each other's nearest are
merged.  Average linkage has no inversions, so one run down to the
loosest threshold holds the clusters of all stricter ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import staged
from .pairs import similar_patterns


def distinct_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern_id, feature) -> items (item, features, n) of equal patterns, and each pattern's item (its least member)."""
    sets = patterns.groupBy("pattern_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    items = sets.groupBy("features").agg(F.min("pattern_id").alias("item"), F.count("*").alias("n"))
    return items, sets.join(items, "features").select("pattern_id", "item")


def _totals(links: DataFrame, owner: DataFrame, member_rows: int = 4096) -> DataFrame:
    """(a, b, total, made): the sum of all members' similarities of each link (a, b, na, nb), from the members' sets, and their number.

    Members of a cluster are dealt to parts of about `member_rows`; each part of one side meets each of the other.
    """
    last = lambda n: F.floor(F.col(n) / member_rows)
    part = F.pmod(F.xxhash64("item"), last("size") + 1)
    held = owner.withColumn("part", part)
    side = lambda c: held.select(F.col("cluster").alias(c), F.col("part").alias(f"part_{c}"), F.col("features").alias(f"f_{c}"), F.col("n").alias(f"w_{c}"))
    laid = links.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), last("na"))).alias("part_a"), "nb").withColumn("part_b", F.explode(F.sequence(F.lit(0).cast("long"), last("nb"))))
    met = laid.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"]).withColumn("shared", F.size(F.array_intersect("f_a", "f_b")))
    alike = F.col("shared") / (F.size("f_a") + F.size("f_b") - F.col("shared"))
    return met.groupBy("a", "b").agg(F.sum(alike * F.col("w_a") * F.col("w_b")).alias("total"), F.count("*").alias("made"))


def linkage_merges(patterns: DataFrame, least: float, most_rounds: int = 500, made: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The dendrogram down to mean similarity `least` as a table: items (item, n, features) and merges (old, new, height, size, round).

    `old` joins `new`, the cluster with the lesser least member, at the mean
    similarity `height` and makes a cluster of `size` patterns; an item is `old`
    once at most.  Heights never rise along a path, so a cut at any threshold of
    at least `least` needs no further run.  A round writes the links and owners of
    the clusters that are left, which carry their sizes.  Raises if clusters are still merging
    after `most_rounds`.

    Pairs of items under `least` are made only where they count.  Clusters whose
    mean reaches it have a pair of members that does, so only linked clusters are
    held, each link with the sum over its known pairs of members.  The unknown
    ones are all under `least`; while the known ones' mean is so too, the link
    cannot merge and stays as it is, otherwise its sum is taken over all members.
    The number of pairs made goes to `made`: those linked at first, then a round's.
    """
    items, _ = distinct_patterns(patterns)
    items = staged(items)
    n = lambda c: items.select(F.col("item").alias(c), F.col("n").alias(f"n{c}"))
    alike = similar_patterns(items, least).join(n("a"), "a").join(n("b"), "b").withColumn("known", F.col("na") * F.col("nb"))
    links = staged(alike.select("a", "b", (F.col("similarity") * F.col("known")).alias("total"), "known", "na", "nb"))
    owner, tables = items.select("item", "n", "features", F.col("item").alias("cluster"), F.col("n").alias("size")), []
    if made is not None:
        made.append(links.count())
    for at in range(most_rounds):
        every = F.col("na") * F.col("nb")
        unsure = links.filter((F.col("known") < every) & (F.col("total") >= (least - 1e-9) * F.col("known")))
        if unsure.take(1):
            whole = staged(_totals(unsure, owner))
            if made is not None:
                made.append(whole.agg(F.sum("made")).first()[0])
            now = links.join(whole.select("a", "b", F.col("total").alias("exact")), ["a", "b"], "left")
            links = staged(now.withColumn("known", F.when(F.col("exact").isNull(), F.col("known")).otherwise(every)).withColumn("total", F.coalesce("exact", "total")).drop("exact"))
        mean = links.filter(F.col("known") == every).select("a", "b", (F.col("total") / every).alias("mean"), (F.col("na") + F.col("nb")).alias("size")).filter(F.col("mean") >= least - 1e-12)
        both = mean.unionByName(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean", "size"))
        nearest = both.groupBy("a").agg(F.min(F.struct((-F.round("mean", 12)).alias("d"), "b", "mean", "size")).alias("m")).select("a", "m.b", "m.mean", "m.size")
        mutual = nearest.groupBy(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")).agg(F.max("mean").alias("height"), F.max("size").alias("size"), F.count("*").alias("sides")).filter("sides = 2")
        merges = staged(mutual.select("old", "new", "height", "size", F.lit(at).alias("round")))
        if tables and not merges.take(1):
            return items, reduce(DataFrame.unionByName, tables)
        tables.append(merges)
        grown = merges.select(F.explode(F.array("old", "new")).alias("cluster"), F.col("new").alias("cluster_new"), F.col("size").alias("size_new"))
        to = lambda c: grown.toDF(c, f"{c}_new", f"n{c}_new")  # noqa: E731, B023
        ends = {"x": ("a_new", "a"), "y": ("b_new", "b"), "nx": ("na_new", "na"), "ny": ("nb_new", "nb")}
        moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(*[F.coalesce(*c).alias(name) for name, c in ends.items()], "total", "known").filter("x <> y")
        first = F.col("x") < F.col("y")
        turned = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"), "total", "known")
        links = staged(turned.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("known").alias("known"), F.max("na").alias("na"), F.max("nb").alias("nb")))
        owner = staged(owner.join(grown, "cluster", "left").select("item", "n", "features", F.coalesce("cluster_new", "cluster").alias("cluster"), F.coalesce("size_new", "size").alias("size")))
    raise RuntimeError(f"clusters still merge after {most_rounds} rounds")


def cut(items: DataFrame, merges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, item, cluster) of a dendrogram at each threshold, by pointer jumping: rounds grow with the logarithm of its depth.

    An item's pointer leads to the cluster that it joined at or above the threshold, doubled until none moves.
    """
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    link = merges.select("old", "new", "height", at).filter(F.col("height") >= F.col("threshold") - 1e-12)
    pointer = staged(link.select("threshold", F.col("old").alias("item"), F.col("new").alias("cluster")))
    while True:
        onward = pointer.select("threshold", F.col("item").alias("cluster"), F.col("cluster").alias("next"))
        step = staged(pointer.join(onward, ["threshold", "cluster"], "left").select("threshold", "item", F.coalesce("next", "cluster").alias("cluster"), F.col("next").isNotNull().alias("moved")))
        pointer = step.drop("moved")
        if not step.filter("moved").take(1):
            return items.select("item", at).join(pointer, ["threshold", "item"], "left").select("threshold", "item", F.coalesce("cluster", "item").alias("cluster"))


def linkage_sweep(patterns: DataFrame, thresholds: list[float], most_rounds: int = 500) -> DataFrame:
    """(threshold, pattern_id, cluster) by threshold: clusters whose mean Jaccard similarity reaches it, named by their least member.

    Patterns without a feature are not part of the input and of no cluster.
    Raises if clusters are still merging after `most_rounds`.
    """
    items, merges = linkage_merges(patterns, min(thresholds), most_rounds)
    _, member = distinct_patterns(patterns)
    return member.join(cut(items, merges, thresholds), "item").select("threshold", "pattern_id", "cluster")


def average_linkage(patterns: DataFrame, threshold: float) -> DataFrame:
    """(pattern_id, cluster) at one threshold."""
    return linkage_sweep(patterns, [threshold]).drop("threshold")


def threshold_stats(assigned: DataFrame) -> DataFrame:
    """(threshold, id, cluster) -> by threshold: clusters, patterns, largest and mean size, clusters per pattern."""
    sizes = assigned.groupBy("threshold", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("threshold").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_patterns"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), (F.count("*") / F.sum("n")).alias("fragmentation"))


def lifecycles(assigned: DataFrame) -> DataFrame:
    """By pattern over the thresholds: how many hold it, first and last, gaps, changes of cluster, trend of its cluster's size (beyond 20 %)."""
    steps = assigned.select("threshold").distinct().withColumn("step", F.row_number().over(W.orderBy("threshold")))
    sized = assigned.join(F.broadcast(steps), "threshold").withColumn("size", F.count("*").over(W.partitionBy("threshold", "cluster")))
    own = W.partitionBy("id").orderBy("step")
    moved = sized.withColumn("changed", F.coalesce((F.lag("cluster").over(own) != F.col("cluster")).cast("int"), F.lit(0)))
    first, last = F.min_by("size", "step"), F.max_by("size", "step")
    return moved.groupBy("id").agg(
        F.count("*").alias("persistence"), F.min("threshold").alias("first"), F.max("threshold").alias("last"), (F.max("step") - F.min("step") + 1 > F.count("*")).alias("has_gaps"), F.sum("changed").alias("cluster_changes"),
        F.when(last > 1.2 * first, "growing").when(last < 0.8 * first, "shrinking").otherwise("stable").alias("size_trend"),
    )


def first_model(members: DataFrame, group: str) -> DataFrame:
    """(cluster, grp, n_states, state) -> of each cluster the group's member from the smallest model, ties to the least state."""
    return members.filter(F.col("grp") == group).groupBy("cluster").agg(F.min(F.struct("n_states", "state")).alias("m")).select("cluster", "m.n_states", "m.state")


def top_clusters(assigned: DataFrame, n: int = 5) -> DataFrame:
    """The n largest clusters of each threshold (ties to the least id) with the threshold's clusters and patterns."""
    sizes = assigned.groupBy("threshold", "cluster").agg(F.count("*").alias("size"))
    whole = W.partitionBy("threshold")
    placed = sizes.withColumns({"place": F.row_number().over(whole.orderBy(F.desc("size"), "cluster")), "n_clusters": F.count("*").over(whole), "n_patterns": F.sum("size").over(whole)})
    return placed.filter(F.col("place") <= n)


def signatures(assigned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(threshold, cluster, signature): features that at least half of a cluster's patterns have, joined by blanks; a cluster without one has no row."""
    sizes = assigned.groupBy("threshold", "cluster").agg(F.count("*").alias("size"))
    held = assigned.join(patterns.select(F.col("pattern_id").alias("id"), "feature"), "id").groupBy("threshold", "cluster", "feature").agg(F.count("*").alias("k"))
    common = held.join(sizes, ["threshold", "cluster"]).filter("2 * k >= size")
    return common.groupBy("threshold", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("feature")), lambda f: f.cast("string")), " ").alias("signature"))


def signature_tracking(top: DataFrame, signed: DataFrame) -> DataFrame:
    """Largest clusters by signature over the thresholds: how often the signature occurs, its number by (count, signature), and signatures at the threshold.

    Works on a few clusters of each threshold, so the numbering is of a small table.
    """
    rows = top.select("threshold", "cluster", "place", "size").join(signed, ["threshold", "cluster"])
    seen = rows.groupBy("signature").agg(F.count("*").alias("persistence"))
    named = seen.withColumn("cluster_group", F.concat(F.lit("G"), F.row_number().over(W.orderBy(F.desc("persistence"), "signature"))))
    at = rows.groupBy("threshold").agg(F.count_distinct("signature").alias("n_signatures"))
    return rows.join(named, "signature").join(at, "threshold")


def lifecycle_xtab(cycles: DataFrame, groups: DataFrame) -> DataFrame:
    """Life cycles (id, size_trend, has_gaps) counted by group, trend and gaps."""
    trend = lambda v: F.count_if(F.col("size_trend") == v).alias(v)
    return cycles.join(groups, "id").groupBy("grp").agg(*map(trend, ("growing", "shrinking", "stable")), F.count_if("has_gaps").alias("with_gaps"), F.count_if(~F.col("has_gaps")).alias("without_gaps"))
