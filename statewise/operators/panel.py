"""Panels: cohorts, dense cells, target series, folds and design tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import ar_lags


def trim_rebase(df: DataFrame, start: int, stop: int, t: str = "t") -> DataFrame:
    """Steps start..stop-1, renumbered from 0."""
    return df.filter((F.col(t) >= start) & (F.col(t) < stop)).withColumn(t, F.col(t) - start)


def bool_parse(df: DataFrame, *cols: str) -> DataFrame:
    """1 where the value reads "true" in any case, else 0 (null too)."""
    return df.withColumns({c: F.coalesce((F.lower(F.col(c).cast("string")) == "true").cast("int"), F.lit(0)) for c in cols})


def target_indicator(seq: DataFrame, target: int) -> DataFrame:
    return seq.withColumn("y", (F.col("state") == target).cast("int"))


def state_relabel(seq: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """States through a mapping; those not in it stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return seq.withColumn("state", F.coalesce(F.try_element_at(pairs, F.col("state")), F.col("state")))


def stratified_sample(subjects: DataFrame, n: dict[str, int], seed: int = 0) -> DataFrame:
    """Exactly n subjects of each group, by order of a hash of subject and seed."""
    order = F.md5(F.concat_ws(":", F.col("subject").cast("string"), F.lit(str(seed))))
    ranked = subjects.select("subject", "grp").distinct().withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy(order, "subject")))
    wanted = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])
    return ranked.filter(F.col("place") <= F.coalesce(F.try_element_at(wanted, F.col("grp")), F.lit(0)))


def densify_binary(marks: DataFrame, keys: DataFrame, size: int, key: str = "participant") -> DataFrame:
    """Every (key, bin 0..size-1) with y = 1 where marked; marks outside are clipped onto the edge bins."""
    clipped = marks.select(key, F.greatest(F.lit(0), F.least(F.col("bin"), F.lit(size - 1))).cast("int").alias("bin")).distinct().withColumn("y", F.lit(1))
    cells = keys.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return cells.join(clipped, [key, "bin"], "left").na.fill(0, ["y"])


def panel_checks(panel: DataFrame, labels: list[int], features: list[str]) -> DataFrame:
    """Violations of the panel: unequal lengths, values not finite, labels outside the set, features not 0/1; a missing value is a violation."""
    per = panel.groupBy("subject").agg(
        F.count("*").alias("n"),
        F.sum((F.isnan("x") | F.col("x").isNull() | (F.abs("x") == float("inf"))).cast("int")).alias("bad_x"),
        F.sum(F.coalesce((~F.col("state").isin(labels)).cast("int"), F.lit(1))).alias("bad_state"),
        F.sum(sum((F.coalesce((~F.col(f).isin(0, 1)).cast("int"), F.lit(1)) for f in features), F.lit(0))).alias("bad_feature"),
    )
    return per.agg(
        F.count("*").alias("n_subjects"), (F.max("n") - F.min("n")).alias("length_gap"),
        F.sum("bad_x").alias("not_finite"), F.sum("bad_state").alias("bad_labels"), F.sum("bad_feature").alias("not_binary"),
    )


def target_series(seq: DataFrame, target: int, prefix: str = "sub-") -> DataFrame:
    """(subject, grp, t, y) with prefixed ids and each subject's mean occupancy."""
    y = (F.col("state") == target).cast("int")
    name = F.col("subject").cast("string")
    return seq.select(F.when(name.startswith(prefix), name).otherwise(F.concat(F.lit(prefix), name)).alias("subject"), "grp", "t", y.alias("y")).withColumn("mean_occupancy", F.avg("y").over(W.partitionBy("subject")))


def participant_sets(a: DataFrame, b: DataFrame, key: str = "participant") -> DataFrame:
    """Members of either set and whether both have them."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    return left.join(right, key, "full_outer").select(key, (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))


def leave_one_out(units: DataFrame, value: str, key: str = "subject") -> DataFrame:
    """(key, value) with a row for each subject -> held_out, and mean, sample deviation and number of all others.

    Totals less the subject's own row: no fold is written out.
    """
    v = F.col(value)
    whole = units.agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count(v).alias("c"))
    n, s, ss = F.col("c") - v.isNotNull().cast("int"), F.col("s") - F.coalesce(v, F.lit(0.0)), F.col("ss") - F.coalesce(v * v, F.lit(0.0))
    mean = F.try_divide(s, n)
    spread = F.when(n > 1, F.sqrt(F.greatest((ss - s * mean) / (n - 1), F.lit(0.0))))
    return units.join(F.broadcast(whole)).select(F.col(key).alias("held_out"), mean.alias("mean"), spread.alias("std"), n.cast("long").alias("n"))


def group_timecourse(panel: DataFrame, value: str = "y") -> DataFrame:
    """Mean and standard error (sample deviation) by group and step."""
    return panel.groupBy("grp", "t").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def two_groups(df: DataFrame, groups: tuple[str, str] | None = None, col: str = "grp") -> tuple[str, str]:
    """The two groups to compare, first and second in order where they are not given; any other number of groups is an error."""
    if groups is not None:
        return groups
    found = sorted(r[col] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"two groups are needed, {'more' if len(found) > 2 else len(found)} found: {found}")
    return found[0], found[1]


def feature_products(features: DataFrame, products: list[tuple[str, str]]) -> DataFrame:
    """Adds the product of each two features, named by both."""
    return features.withColumns({f"{a}_{b}": F.col(a) * F.col(b) for a, b in products})


def design_matrix(panel: DataFrame, features: DataFrame, names: list[str], lags: int = 2, coding: str = "deviation", groups: tuple[str, str] | None = None, products: list[tuple[str, str]] | None = None) -> DataFrame:
    """Panel (subject, grp, t, y) with features of the step and products of theirs, group code, lags and group products.

    deviation codes the first group +1 and the second -1; treatment codes them
    0 and 1.  Groups other than two are an error.
    """
    first, second = two_groups(panel, groups)
    low, high = (1, -1) if coding == "deviation" else (0, 1)
    coded = ar_lags(panel, lags).withColumn("group_coded", F.when(F.col("grp") == first, low).when(F.col("grp") == second, high))
    made = feature_products(features.select("t", *names), products or [])
    joined = coded.join(F.broadcast(made), "t")  # a row for each step, no more than the longest series has in its window's task; subjects are not dealt anew
    return joined.withColumns({f"group_{f}_interaction": F.col("group_coded") * F.col(f) for f in made.columns if f != "t"})


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls of the named columns replaced by their default."""
    return df.na.fill(defaults)


def paired_series(by_group: dict[str, DataFrame], targets: dict[str, int], prefix: str = "sub-") -> DataFrame:
    """Target series of several models under one another: each group from its own model's states and with its own target."""
    parts = [target_series(seq.filter(F.col("grp") == g), targets[g], prefix) for g, seq in by_group.items()]
    return reduce(DataFrame.unionByName, parts)
