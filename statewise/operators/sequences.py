"""Analytics of ordered state sequences: long tables (subject, t, state), one shuffle by subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import correlation

KEY, ORDER = ["subject"], "t"


def entropy(p: Column, floor: float = 0.0) -> Column:
    """One term -p ln p; 0 at p = 0."""
    return F.when(p > floor, -p * F.log(p)).otherwise(F.lit(0.0))


def state_runs(seq: DataFrame, step: float = 1.5) -> DataFrame:
    """Maximal runs of one state: subject, run, state, start, length, duration; the last run counts."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    change = (F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state"))).cast("int")
    marked = seq.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return marked.groupBy(*KEY, "run").agg(F.first("state").alias("state"), F.min(ORDER).alias("start"), F.count("*").alias("length")).withColumn("duration", F.col("length") * step)


def changes(seq: DataFrame) -> DataFrame:
    """Steps at which the state changes: subject, from_state, to_state."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    return seq.select(*KEY, F.lag("state").over(w).alias("from_state"), F.col("state").alias("to_state")).filter("from_state <> to_state")


def states(k: int, name: str = "state") -> DataFrame:
    """Column expression of the k state codes, to be exploded beside a key."""
    return F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)


def occupancy(seq: DataFrame, k: int) -> DataFrame:
    """Share of steps in each state per subject; states never visited have 0."""
    counts = seq.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.sum((F.col("state") == s).cast("int")).alias(f"s{s}") for s in range(k)])
    return counts.select(*KEY, F.posexplode(F.array(*[F.col(f"s{s}") / F.col("n") for s in range(k)])).alias("state", "occupancy"))


def duration_stats(seq: DataFrame, k: int, step: float = 1.5) -> DataFrame:
    """Run durations per subject and state: mean, population deviation, median, max, min, count; zeros without a run."""
    stats = state_runs(seq, step).groupBy(*KEY, "state").agg(
        F.avg("duration").alias("mean_duration"), F.stddev_pop("duration").alias("std_duration"), F.percentile("duration", 0.5).alias("median_duration"),
        F.max("duration").alias("max_duration"), F.min("duration").alias("min_duration"), F.count("*").alias("n_runs"),
    )
    dense = seq.select(*KEY).distinct().select(*KEY, states(k))
    return dense.join(stats, [*KEY, "state"], "left").na.fill(0)


def group_durations(seq: DataFrame, step: float = 1.5) -> DataFrame:
    """Run durations pooled over all subjects, by state."""
    return state_runs(seq, step).groupBy("state").agg(F.avg("duration").alias("mean_duration"), F.stddev_pop("duration").alias("std_duration"), F.percentile("duration", 0.5).alias("median_duration"), F.count("*").alias("n_runs"))


def transition_matrix(seq: DataFrame, k: int) -> DataFrame:
    """Mean over subjects of each subject's row-normalised change counts (rows without a change are 0)."""
    per = changes(seq).groupBy(*KEY, "from_state", "to_state").count()
    share = per.withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy(*KEY, "from_state")))
    total = share.groupBy("from_state", "to_state").agg(F.sum("p").alias("p"))
    n = seq.select(F.count_distinct(*KEY).alias("n"))
    dense = n.select("n", states(k, "from_state")).select("n", "from_state", states(k, "to_state"))
    return dense.join(total, ["from_state", "to_state"], "left").select("from_state", "to_state", F.coalesce(F.col("p") / F.col("n"), F.lit(0.0)).alias("probability"))


def switching_rate(seq: DataFrame, step: float = 1.5) -> DataFrame:
    """Changes per second over all subjects, and changes per step taken."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    flags = seq.select(*KEY, (F.lag("state").over(w) != F.col("state")).cast("int").alias("changed"))
    return flags.agg(F.sum("changed").alias("n_changes"), (F.sum("changed") / (F.count("*") * step)).alias("per_second"), (F.sum("changed") / F.count("changed")).alias("per_step"))


def transition_entropy(seq: DataFrame, k: int) -> DataFrame:
    """Entropy (nats) of each row of the mean transition matrix, its probabilities scaled to 1."""
    m = transition_matrix(seq, k).withColumn("p", F.try_divide("probability", F.sum("probability").over(W.partitionBy("from_state"))))
    return m.groupBy("from_state").agg(F.coalesce(F.sum(entropy(F.col("p"))), F.lit(0.0)).alias("entropy"))


def usage_metrics(seq: DataFrame, k: int) -> DataFrame:
    """State entropy, usage balance (1 - population CV of shares) and consistency over time (1 - mean entropy at t / ln k)."""
    share = seq.groupBy("state").count().select("state", (F.col("count") / F.sum("count").over(W.partitionBy())).alias("p"))
    dense = seq.sparkSession.range(1).select(states(k)).join(share, "state", "left").na.fill(0.0)
    one = dense.agg(F.sum(entropy(F.col("p"))).alias("state_entropy"), (1 - F.stddev_pop("p") / F.avg("p")).alias("usage_balance"))
    at = seq.groupBy(ORDER, "state").count().withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy(ORDER)))
    two = at.groupBy(ORDER).agg(F.sum(entropy(F.col("p"))).alias("h")).agg((1 - F.avg("h") / F.log(F.lit(float(k)))).alias("temporal_consistency"))
    return one.crossJoin(two)


def binary_runs(seq: DataFrame, target: int, step: float = 1.5) -> DataFrame:
    """Runs of the target state (y = 1) and of everything else (y = 0)."""
    return state_runs(seq.withColumn("state", (F.col("state") == target).cast("int")), step).withColumnRenamed("state", "y")


def entry_exit(seq: DataFrame, target: int) -> DataFrame:
    """Share of steps that enter and that leave the target state, by group."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    y = (F.col("state") == target).cast("int")
    d = seq.withColumn("y", y).withColumn("d", F.col("y") - F.lag("y").over(w)).filter("d is not null")
    return d.groupBy("grp").agg(F.avg((F.col("d") == 1).cast("double")).alias("entry_rate"), F.avg((F.col("d") == -1).cast("double")).alias("exit_rate"))


def state_mixing(seq: DataFrame, k: int, frame: int = 13) -> DataFrame:
    """Distinct states / k in full frames that do not overlap."""
    frames = seq.groupBy(*KEY, F.floor(F.col(ORDER) / frame).alias("frame")).agg(F.count("*").alias("n"), (F.count_distinct("state") / k).alias("mixing"))
    return frames.filter(F.col("n") == frame).drop("n")


def sliding_entropy(seq: DataFrame, k: int, frame: int = 13) -> DataFrame:
    """Mean entropy of the state histogram in every frame of the given length; the last start is left out."""
    ahead = W.partitionBy(*KEY).orderBy(ORDER).rowsBetween(0, frame - 1)
    n = F.count("*").over(W.partitionBy(*KEY))
    shares = [F.sum((F.col("state") == s).cast("int")).over(ahead) / F.lit(float(frame)) for s in range(k)]
    rows = seq.select(*KEY, ORDER, n.alias("n"), sum((entropy(p) for p in shares), F.lit(0.0)).alias("h"))
    return rows.filter(F.col(ORDER) < F.col("n") - frame).groupBy(*KEY).agg(F.avg("h").alias("mean_entropy"), F.count("*").alias("n_frames"))


def recurrence(seq: DataFrame, step: float = 1.5) -> DataFrame:
    """Mean and median time between visits of the same state by the same subject, by state (steps within a run count)."""
    w = W.partitionBy(*KEY, "state").orderBy(ORDER)
    gaps = seq.withColumn("gap", (F.col(ORDER) - F.lag(ORDER).over(w)) * step).filter("gap is not null")
    return gaps.groupBy("state").agg(F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.5).alias("median_gap"), F.count("*").alias("n_gaps"))


def ar_lags(panel: DataFrame, lags: int, y: str = "y") -> DataFrame:
    """y of the 1..lags steps before; 0 where there is none."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    return panel.withColumns({f"{y}_lag{j}": F.lag(y, j, 0).over(w) for j in range(1, lags + 1)})


def zscore(seq: DataFrame, sample: bool = False) -> DataFrame:
    """x to mean 0 and deviation 1 within its series; null where the series does not vary."""
    w = W.partitionBy(*KEY)
    sd = (F.stddev_samp if sample else F.stddev_pop)("x").over(w)
    return seq.withColumn("z", F.when(sd > 0, (F.col("x") - F.avg("x").over(w)) / sd))


def detrend(seq: DataFrame) -> DataFrame:
    """x without its series' least-squares line in t."""
    fit = seq.groupBy(*KEY).agg(F.regr_slope("x", ORDER).alias("slope"), F.regr_intercept("x", ORDER).alias("intercept"))
    return seq.join(fit, KEY).withColumn("residual", F.col("x") - F.col("intercept") - F.col("slope") * F.col(ORDER)).drop("slope", "intercept")


def state_probability(seq: DataFrame, k: int) -> DataFrame:
    """Share of each group's subjects in each state at each step, dense."""
    counts = seq.groupBy("grp", ORDER).agg(F.count("*").alias("n"), *[F.sum((F.col("state") == s).cast("int")).alias(f"s{s}") for s in range(k)])
    return counts.select("grp", ORDER, F.posexplode(F.array(*[F.col(f"s{s}") / F.col("n") for s in range(k)])).alias("state", "probability"))


def cluster_group_stats(seq: DataFrame, target: int, step: float = 1.5) -> DataFrame:
    """By group: occupancy of the target over subjects, run lengths in it and interval lengths outside."""
    y = (F.col("state") == target).cast("int")
    occ = seq.groupBy("grp", *KEY).agg(F.avg(y).alias("o")).groupBy("grp").agg(F.avg("o").alias("mean_occupancy"), F.stddev_pop("o").alias("std_occupancy"), F.count("*").alias("n_subjects"))
    runs = binary_runs(seq, target, step).join(seq.select(*KEY, "grp").distinct(), KEY)
    part = lambda v, name: (F.avg(F.when(F.col("y") == v, F.col("length"))).alias(f"mean_{name}"), F.stddev_pop(F.when(F.col("y") == v, F.col("length"))).alias(f"std_{name}"))
    return occ.join(runs.groupBy("grp").agg(*part(1, "run"), *part(0, "interval")), "grp")


def acf(seq: DataFrame, lags: int = 10, x: str = "x") -> DataFrame:
    """Mean over subjects of the Pearson correlation of the series with itself shifted; undefined counts as 0."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    wide = seq.select(*KEY, x, *[F.lag(x, j).over(w).alias(f"l{j}") for j in range(1, lags + 1)])
    per = wide.groupBy(*KEY).agg(*[F.coalesce(correlation(F.col(x), F.col(f"l{j}")), F.lit(0.0)).alias(f"l{j}") for j in range(1, lags + 1)])
    means = per.agg(*[F.avg(f"l{j}").alias(f"l{j}") for j in range(1, lags + 1)])
    return means.select(F.posexplode(F.array(*[f"l{j}" for j in range(1, lags + 1)])).alias("lag", "acf")).withColumn("lag", F.col("lag") + 1)


def gauss_smooth(course: DataFrame, sigma: float = 2.0, value: str = "value") -> DataFrame:
    """Gaussian smoothing of (grp, t, value), radius 4 sigma, edges reflected; t runs from 0 without gaps."""
    radius = int(4 * sigma + 0.5)
    n = F.count("*").over(W.partitionBy("grp"))
    rows = course.select("grp", ORDER, F.col(value).alias("v"), n.alias("n"))
    offset = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset")
    spread = rows.select("grp", ORDER, "n", offset)
    place = F.pmod(F.col(ORDER) + F.col("offset"), 2 * F.col("n"))
    at = spread.withColumn("at", F.when(place < F.col("n"), place).otherwise(2 * F.col("n") - 1 - place)).withColumn("weight", F.exp(-0.5 * F.pow(F.col("offset") / sigma, 2)))
    found = at.join(rows.select("grp", F.col(ORDER).alias("at"), "v"), ["grp", "at"])
    return found.groupBy("grp", ORDER).agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("smoothed"))


def transition_rate(seq: DataFrame, *by: str) -> DataFrame:
    """Changes of state per possible change (steps after the first of each subject), by group."""
    w = W.partitionBy(*KEY).orderBy(ORDER)
    flags = seq.select(*by, (F.lag("state").over(w) != F.col("state")).cast("int").alias("changed"))
    return flags.groupBy(*by).agg((F.sum("changed") / F.count("changed")).alias("transition_rate"))
