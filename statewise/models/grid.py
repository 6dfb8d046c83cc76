"""Hidden-state models over a grid of state numbers and cohorts, all fitted in the same jobs, and the choice among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.inference import bic
from .hmm import Params, _em, initial

_FITS = (
    "cohort string, k int, restart int, n_subjects long, n long, d int, log_likelihood double, rounds int, converged boolean, "
    "start array<double>, transition array<array<double>>, mean array<array<double>>, cov array<array<array<double>>>"
)


def fit_grid(
    data: DataFrame, ks: list[int], cohorts: dict[str, list[str]], restarts: int = 5, most_rounds: int = 1000, tol: float = 1e-3, ridge: float = 1e-6, seed: int = 0
) -> DataFrame:
    """(subject, t, x array, grp) -> one row a cohort, number of states and restart, with the fit and its parameters.

    A cohort is a list of groups and may share them with others; a series is
    read once a round for all models that see it, and a model leaves the job as
    it settles.  The driver holds k d^2 numbers a model, so the grid is the
    caller's bound.  A cohort without a series has no row.
    """
    names = sorted({g for groups in cohorts.values() for g in groups})
    number = F.array_position(F.array(*map(F.lit, names)), F.col("grp")).cast("int")
    own = data.filter(F.col("grp").isin(names)).withColumn("fold", number)
    found = own.groupBy("grp").agg(F.count_distinct("subject").alias("n_subjects"), F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()
    known = {r["grp"]: r for r in found}
    held = {c: [known[g] for g in groups if g in known] for c, groups in cohorts.items()}
    keys = [(c, k, r) for c in cohorts if held[c] for k in ks for r in range(restarts)]
    params = {i: initial(k, held[c][0]["d"], seed + r) for i, (c, k, r) in enumerate(keys)}
    skip = {i: {at for at, g in enumerate(names, 1) if g not in cohorts[c]} for i, (c, _, _) in enumerate(keys)}
    history = _em(own, params, most_rounds, tol, ridge, skip)
    rows = []
    for i, (c, k, r) in enumerate(keys):
        p: Params = params[i]
        subjects, steps = (sum(g[name] for g in held[c]) for name in ("n_subjects", "n"))
        shape = (np.asarray(a).tolist() for a in (p.start, p.transition, p.mean, p.cov))
        rows.append((c, k, r, subjects, steps, held[c][0]["d"], history[i][-1], len(history[i]), p.converged, *shape))
    return data.sparkSession.createDataFrame(rows, _FITS)


def selected(fits: DataFrame, by: tuple[str, ...] = ("cohort", "k")) -> DataFrame:
    """The restart kept for each cohort and number of states, by BIC: fits plus n_parameters, bic, place in its cohort, init_stability.

    Kept is the best likelihood among the restarts that settled, among all
    where none did; ties go to the first.  `init_stability` is 1 - deviation /
    |mean| over the restarts' likelihoods.
    """
    own = W.partitionBy(*by)
    spread = 1 - F.try_divide(F.stddev_pop("log_likelihood").over(own), F.abs(F.avg("log_likelihood").over(own)))
    order = own.orderBy(F.desc("converged"), F.desc("log_likelihood"), "restart")
    kept = fits.withColumns({"init_stability": spread, "_at": F.row_number().over(order)}).filter("_at = 1").drop("_at")
    return bic(kept).withColumn("place", F.row_number().over(W.partitionBy(by[0]).orderBy("bic", "k")))
