"""State patterns over features: statistics per state, masks, ordering and cluster summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import clip
from ..sources.shared import free_names, numbered
from .inference import poisson_weighted
from .pairs import cosine, pair_sums


def state_feature_stats(obs: DataFrame, k: int | None = None) -> DataFrame:
    """(state, feature, value) -> mean, population deviation, CV (0 where undefined) and importance |mean| * deviation.

    With `k`, states 0..k-1 that were never visited have zeros in every feature.
    """
    m = obs.groupBy("state", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    if k is not None:
        cells = obs.select("feature").distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        m = cells.join(m, ["state", "feature"], "left").na.fill(0, ["mean", "std", "n"])
    return m.withColumn("cv", F.coalesce(F.try_divide("std", F.abs("mean")), F.lit(0.0))).withColumn("importance", F.abs("mean") * F.col("std"))


def top_features(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n most important features of each state, ties by feature."""
    w = W.partitionBy("state").orderBy(F.desc("importance"), "feature")
    return stats.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def state_covariance(wide: DataFrame, features: list[str]) -> DataFrame:
    """Population covariance and correlation (clipped to -1..1, 0 where a feature does not vary) of every two features by state.

    Tasks add up cross products of their rows, taken from the features' overall
    means; what is shuffled is a square of the number of features for each
    state and task.
    """
    d = len(features)
    kind = wide.schema["state"].dataType.simpleString()
    slim = wide.select("state", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    shift = np.array([v or 0.0 for v in wide.agg(*[F.avg(f) for f in features]).first()])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for state, own in pdf.groupby("state", dropna=False):
                x = np.stack(own["x"].to_list()).astype(float) - shift
                x = np.column_stack([np.ones(len(x)), x])[~np.isnan(x).any(1)]
                held[state] = held.get(state, 0.0) + x.T @ x
        yield pd.DataFrame([(s, m.ravel()) for s, m in held.items()], columns=["state", "sums"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((d + 1) ** 2)
        m[pdf["i"].to_numpy()] = pdf["v"].to_numpy()
        m = m.reshape(d + 1, d + 1)
        n = max(m[0, 0], 1.0)
        cov = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n / n
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        sd[sd <= 1e-12 * (1 + np.sqrt(np.diag(m)[1:] / n))] = 0.0
        scale = np.outer(sd, sd)
        corr = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0).clip(-1, 1)
        p, q = np.triu_indices(d)
        names = np.array(features)
        return pd.DataFrame({"state": pdf["state"].iloc[0], "f1": names[p], "f2": names[q], "cov": cov[p, q], "corr": corr[p, q]})

    parts = slim.mapInPandas(add, f"state {kind}, sums array<double>").select("state", F.posexplode("sums").alias("i", "v"))
    return parts.groupBy("state", "i").agg(F.sum("v").alias("v")).groupBy("state").applyInPandas(finish, f"state {kind}, f1 string, f2 string, cov double, corr double")


def effective_dimension(cov: DataFrame, floor: float = 1e-12) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of their squares, from the trace and the squared entries."""
    twice = F.when(F.col("f1") == F.col("f2"), 1.0).otherwise(2.0)
    trace = F.sum(F.when(F.col("f1") == F.col("f2"), F.col("cov")))
    return cov.groupBy("state").agg((trace * trace / (F.sum(twice * F.col("cov") * F.col("cov")) + floor)).alias("effective_dim"))


def reliable(stats: DataFrame, least: float, widest: float, stability: float) -> DataFrame:
    """Patterns whose largest |mean| and widest interval pass, from (pattern, mean, ci_lower, ci_upper, stability)."""
    return stats.groupBy("pattern").agg(F.max(F.abs("mean")).alias("peak"), F.max(F.col("ci_upper") - F.col("ci_lower")).alias("width"), F.max("stability").alias("stability")).filter((F.col("peak") >= least) & (F.col("width") <= widest) & (F.col("stability") >= stability))


def significant_features(stats: DataFrame, least: float, fixed: float | None = None) -> DataFrame:
    """Features with mean over `least` and lower bound over 0.1 * (1 - stability), or over a fixed bound."""
    bound = F.lit(fixed) if fixed is not None else 0.1 * (1 - F.col("stability"))
    return stats.filter((F.col("mean") > least) & (F.col("ci_lower") > bound))


def sorted_index(occupancy: DataFrame) -> DataFrame:
    """States renumbered from 0 by mean occupancy, largest first, ties by state."""
    m = occupancy.groupBy("state").agg(F.avg("occupancy").alias("occupancy"))
    return m.withColumn("sorted_index", F.row_number().over(W.orderBy(F.desc("occupancy"), "state")) - 1)


def consensus_mean(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Mean vector of each cluster's members, and whether at least half of them have the feature."""
    return members.join(vectors, "id").groupBy("cluster", "feature").agg(F.avg("value").alias("mean"), (F.avg(F.col("active").cast("double")) >= 0.5).alias("consensus"))


def cluster_summary(members: DataFrame, groups: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Size, summed occupancy and groups of each cluster, and a count `n_<group>` for each of the named groups."""
    counts = [F.count_if(F.col("grp") == g).alias(f"n_{g}") for g in groups]
    return members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("occupancy").alias("total_occupancy"), F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("groups"), *counts)


def cluster_overlap(members: DataFrame, groups: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Clusters that more than one of the groups shares, with their members by group."""
    counts = [f"n_{g}" for g in groups]
    shared = sum(((F.col(c) > 0).cast("int") for c in counts), F.lit(0)) > 1
    return cluster_summary(members, groups).filter(shared).select("cluster", *counts)


def renumbered(members: DataFrame) -> DataFrame:
    """(id, cluster, occupancy) with `number`: clusters from 1 by summed occupancy, largest first, ties to the cluster with the least member."""
    sums = members.groupBy("cluster").agg(F.sum("occupancy").alias("total"), F.min("id").alias("least"))
    places = numbered(sums, F.desc("total"), F.col("least")).select("cluster", (F.col("number") + 1).alias("number"))
    return members.join(places, "cluster")


def find_member(members: DataFrame, cluster, grp: str, model: str) -> DataFrame:
    """The member of a cluster from a group's model; where there is none, an error that lists what there is instead."""
    of_cluster = members.filter(F.col("cluster") == cluster)
    found = of_cluster.filter((F.col("grp") == grp) & (F.col("model") == model))
    if found.limit(1).count():
        return found
    if not of_cluster.limit(1).count():
        raise LookupError(f"no cluster {cluster}")
    models = [r["model"] for r in of_cluster.filter(F.col("grp") == grp).select("model").distinct().orderBy("model").limit(100).collect()]
    if not models:
        groups = [r["grp"] for r in of_cluster.select("grp").distinct().orderBy("grp").limit(100).collect()]
        raise LookupError(f"cluster {cluster} has no member of group {grp}; it has groups {groups}")
    raise LookupError(f"cluster {cluster} has no member of group {grp} from {model}; it has {models}")


def best_match(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Cluster of the previous threshold with the largest Jaccard of members, ties to the least id; none at 0."""
    c, p = current.groupBy("cluster").agg(F.count("*").alias("nc")), previous.groupBy("cluster").agg(F.count("*").alias("np"))
    shared = current.select("id", F.col("cluster").alias("c")).join(previous.select("id", F.col("cluster").alias("p")), "id").groupBy("c", "p").agg(F.count("*").alias("k"))
    scored = shared.join(c.withColumnRenamed("cluster", "c"), "c").join(p.withColumnRenamed("cluster", "p"), "p").withColumn("jaccard", F.col("k") / (F.col("nc") + F.col("np") - F.col("k")))
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("c").orderBy(F.desc("jaccard"), "p"))).filter("place = 1")
    return c.select(F.col("cluster").alias("c")).join(best.select("c", "p", "jaccard"), "c", "left").select("c", "p", "jaccard", F.when(F.col("jaccard") >= 0.7, "stable").when(F.col("jaccard") >= 0.5, "moderate").otherwise("unstable").alias("verdict"))


def lost_gained(current: DataFrame, following: DataFrame) -> DataFrame:
    """Patterns common to two thresholds, lost and gained."""
    j = current.select("id", F.lit(1).alias("x")).join(following.select("id", F.lit(1).alias("y")), "id", "full_outer")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count_if(F.col("y").isNull()).alias("lost"), F.count_if(F.col("x").isNull()).alias("gained"))


def _halves(obs: DataFrame) -> DataFrame:
    w = W.partitionBy("state", "feature")
    return obs.withColumn("first", F.row_number().over(w.orderBy("id")) <= F.floor(F.count("*").over(w) / 2))


def split_half(obs: DataFrame) -> DataFrame:
    """Cosine of the mean patterns of the first and second half of each state's rows (in order), clipped to 0..1."""
    m = _halves(obs).groupBy("state", "feature").agg(F.avg(F.when(F.col("first"), F.col("value"))).alias("x"), F.avg(F.when(~F.col("first"), F.col("value"))).alias("y"))
    return m.groupBy("state").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("x"), F.col("y")))).alias("stability"))


def split_half_interval(obs: DataFrame, draws: int = 100, seed: int = 0) -> DataFrame:
    """Percentile interval and population deviation of `split_half` over draws in which each row of a half counts a hashed Poisson number of times.

    All features of a row share its count.  The partial sums of a draw are made
    where the rows are; states x features x draws of them are shuffled.
    """
    halves = _halves(obs).select("state", "feature", "first", "value", "id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weighted = poisson_weighted(halves, ["state", "id", "draw"], seed)
    part = lambda on: F.try_divide(F.sum(F.when(on, F.col("w") * F.col("value"))), F.sum(F.when(on, F.col("w"))))
    m = weighted.groupBy("state", "draw", "feature").agg(part(F.col("first")).alias("x"), part(~F.col("first")).alias("y"))
    drawn = m.groupBy("state", "draw").agg(clip(cosine(F.col("x"), F.col("y")), 0.0, 1.0).alias("c"))
    return drawn.groupBy("state").agg(F.percentile("c", 0.025).alias("ci_lower"), F.percentile("c", 0.975).alias("ci_upper"), F.stddev_pop("c").alias("std"))


def pattern_consistency(obs: DataFrame) -> DataFrame:
    """(subject, state, feature, value) -> cosine of each subject's mean pattern of a state with the state's over all rows."""
    own = obs.groupBy("subject", "state", "feature").agg(F.avg("value").alias("x"))
    whole = obs.groupBy("state", "feature").agg(F.avg("value").alias("y"))
    return own.join(whole, ["state", "feature"]).groupBy("subject", "state").agg(cosine(F.col("x"), F.col("y")).alias("cosine"))


def state_distance(means: DataFrame) -> DataFrame:
    """Euclidean distance of every two states of (state, feature, mean)."""
    sums = pair_sums(means.select(F.col("state").alias("id"), F.col("feature").alias("at"), F.col("mean").alias("v")))
    return sums.select("a", "b", F.sqrt(F.greatest(F.col("square_a") + F.col("square_b") - 2 * F.col("product"), F.lit(0.0))).alias("distance"))


def consensus_check(active: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Share of a cluster's members with each feature, and whether half of them agrees with the stored consensus (missing: false)."""
    share = members.select("id", "cluster").join(active, "id").groupBy("cluster", "feature").agg(F.avg(F.col("active").cast("double")).alias("frequency"))
    known = stored.select("cluster", "feature", F.col("consensus").alias("stored"))
    return share.join(known, ["cluster", "feature"], "left").select("cluster", "feature", "frequency", ((F.col("frequency") >= 0.5) == F.coalesce("stored", F.lit(False))).alias("matches"))


def model_state_pivot(members: DataFrame, n_states: int) -> DataFrame:
    """(model, sorted_state, cluster) -> a row for each model in natural order of its number of states, a column for each state with its least cluster."""
    number = F.regexp_extract("model", r"(\d+)_?states", 1).cast("int").alias("n_states")
    wide = members.groupBy("model", number).pivot("sorted_state", list(range(n_states))).agg(F.min("cluster"))
    return wide.select("model", "n_states", *[F.col(str(i)).alias(f"s{i}") for i in range(n_states)]).orderBy("n_states", "model")


def model_consistency(states: DataFrame, low: float = 0.1) -> DataFrame:
    """(model, subject, state, occupancy, cosine, stability) -> by model: per cent of states used less than `low`, largest variance of a state's cosine over subjects, mean stability."""
    by = states.groupBy("model", "state").agg(F.avg("occupancy").alias("occupancy"), F.var_pop("cosine").alias("spread"), F.avg("stability").alias("stability"))
    return by.groupBy("model").agg((100 * F.avg((F.col("occupancy") < low).cast("double"))).alias("pct_low_freq"), F.max("spread").alias("max_pattern_var"), F.avg("stability").alias("mean_stability"))


def embed(vectors: DataFrame, k: int = 2, column: str = "embedding") -> DataFrame:
    """Principal components of an array column, most variance first; signs are those of the solver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v, p = free_names(vectors, "v", "p")
    held = vectors.withColumn(v, array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    placed = PCA(k=k, inputCol=v, outputCol=p).fit(held).transform(held)
    return placed.withColumn(p, vector_to_array(p)).select(*vectors.columns, *[F.col(p)[i].alias(f"pc{i + 1}") for i in range(k)])
