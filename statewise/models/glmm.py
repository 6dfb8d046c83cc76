"""Binomial mixed model with a random intercept per subject, by penalised Newton steps.

A subject's rows with the same features count as one row of so many trials, as
nothing else enters the likelihood.  In each step a subject's own intercept is
set to its mode and eliminated inside the task that holds the subject's rows,
many subjects side by side; Spark sums p + p^2 numbers per model, and the driver
solves a p x p system.  Models (features, folds) are keys of the same job.

Models whose Newton steps do not settle (separated data under a wide prior) fall
back to a variational fit: the logistic terms are replaced by their quadratic
lower bound, whose local parameters (one a row) are set inside the subject's
task.  Under the bound coefficients and intercepts are jointly normal with one
arrow of correlations a subject, so intercepts are eliminated exactly in the
same way; Spark sums 2 (p + p^2) + 3 numbers and the bound of the evidence rises in
every round.  Both fits give a log evidence, so a model can be held against a
simpler one that is one more key of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .sums import summed


#: Rows of one matrix of a task: subjects are worked on side by side up to so many.
_ROWS = 1 << 14


def _intercepts(eta: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray, var: float, trials: np.ndarray) -> np.ndarray:
    """Modes of the intercepts of subjects whose rows lie end to end, each with Newton steps of its own until they settle."""
    b, live = np.zeros(len(first)), np.ones(len(first), bool)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(eta + np.repeat(b, size))))
        step = (np.add.reduceat(y - trials * p, first) - b / var) / (np.add.reduceat(trials * p * (1 - p), first) + 1 / var)
        b = np.where(live, b + np.clip(step, -4, 4), b)
        live &= np.abs(step) >= 1e-10
        if not live.any():
            break
    return b


def batch_stats(x: np.ndarray, y: np.ndarray, first: np.ndarray, beta: np.ndarray, var: float, each: bool = False, trials: np.ndarray | None = None) -> np.ndarray:
    """Gradient, Hessian after elimination of the intercept, the intercept's share of Laplace's log evidence, penalised log-likelihood, second moment of the intercept, 1.

    Subjects' rows lie end to end and begin at `first`; their sum, or a row for
    `each`.  y is what the `trials` of a row add up to; without them a row is one.
    """
    trials = np.ones(len(y)) if trials is None else trials
    eta, size = x @ beta, np.diff(first, append=len(y))
    b = _intercepts(eta, y, first, size, var, trials)
    p = 1 / (1 + np.exp(-(eta + np.repeat(b, size))))
    w = trials * p * (1 - p)
    xw = np.add.reduceat(x * w[:, None], first)
    own = np.add.reduceat(w, first) + 1 / var
    ll = np.add.reduceat(y * np.log(p + 1e-300) + (trials - y) * np.log(1 - p + 1e-300), first) - b * b / (2 * var)
    rest = np.column_stack([-0.5 * np.log(var * own), ll, b * b + 1 / own, np.ones(len(b))])
    if not each:
        return np.concatenate([x.T @ (y - trials * p), ((x * w[:, None]).T @ x - (xw / own[:, None]).T @ xw).ravel(), rest.sum(0)])
    hessian = np.add.reduceat((x * w[:, None])[:, :, None] * x[:, None, :], first) - xw[:, :, None] * xw[:, None, :] / own[:, None, None]
    return np.column_stack([np.add.reduceat(x * (y - trials * p)[:, None], first), hessian.reshape(len(b), -1), rest])


def _half_slope(xi: np.ndarray) -> np.ndarray:
    """Curvature of the quadratic bound of log(1 / (1 + exp(-z))) that touches it at -xi and xi."""
    small = np.abs(xi) < 1e-6
    return np.where(small, 0.125, np.tanh(xi / 2) / np.where(small, 1.0, 4 * xi))


def batch_bound(x: np.ndarray, y: np.ndarray, first: np.ndarray, mean: np.ndarray, cov: np.ndarray, var: float, inner: int = 100, tol: float = 1e-9, trials: np.ndarray | None = None) -> np.ndarray:
    """Sum of subjects' parts of the bound, their intercepts integrated out, as a quadratic in the coefficients: slope, curvature; the intercept's second moment as one, alike; both constants, 1.

    Subjects' rows lie end to end and begin at `first`.  The local parameters are
    the root mean squares of the linear predictor under coefficients of `mean` and
    `cov` and the intercept given them, each subject's to a fixed point; those that
    have settled are left out of further steps.  Rows are of `trials` as in
    `batch_stats`; those of one row share its local parameter.
    """
    trials = np.ones(len(y)) if trials is None else trials
    n, size = len(first), np.diff(first, append=len(y))
    half, eta, spread = y - trials / 2, x @ mean, np.einsum("ij,ij->i", x @ cov, x)
    r, xi = np.add.reduceat(half, first), np.sqrt(eta**2 + spread + var)
    summed_over = lambda lam, x, first: (1 / var + 2 * np.add.reduceat(lam, first), 2 * np.add.reduceat(x * lam[:, None], first))
    live, rows = np.arange(n), np.arange(len(y))
    for _ in range(inner):
        own = size[live]
        begin = np.cumsum(own) - own
        some, lam = x[rows], _half_slope(xi[rows])
        d, c = summed_over(trials[rows] * lam, some, begin)
        b, sc = (r[live] - c @ mean) / d, c @ cov
        linear = np.einsum("ij,ij->i", some, np.repeat(sc / d[:, None], own, axis=0))
        level = 1 / d + np.einsum("ij,ij->i", c, sc) / d**2
        new = np.sqrt(np.maximum((eta[rows] + np.repeat(b, own)) ** 2 + spread[rows] - 2 * linear + np.repeat(level, own), 0.0))
        moving = np.maximum.reduceat(np.abs(new - xi[rows]), begin) >= tol
        xi[rows] = new
        rows, live = rows[np.repeat(moving, own)], live[moving]
        if not len(live):
            break
    lam = _half_slope(xi)
    d, c = summed_over(trials * lam, x, first)
    constant = (r * r / (2 * d) - 0.5 * np.log(var * d)).sum() + (trials * (lam * xi**2 - xi / 2 - np.logaddexp(0.0, -xi))).sum()
    curvature = (x * (2 * trials * lam)[:, None]).T @ x - (c / d[:, None]).T @ c
    return np.concatenate([x.T @ half - (r / d) @ c, curvature.ravel(), -2 * (r / d**2) @ c, ((c / d[:, None] ** 2).T @ c).ravel(), [constant, (1 / d + (r / d) ** 2).sum(), n]])


def subject_bound(x: np.ndarray, y: np.ndarray, mean: np.ndarray, cov: np.ndarray, var: float, inner: int = 100, tol: float = 1e-9) -> np.ndarray:
    """`batch_bound` of one subject."""
    return batch_bound(x, y, np.zeros(1, int), mean, cov, var, inner, tol)


def _ahead(path: list[float]) -> float:
    """Where three steps of the variance lead if they go on shrinking at their rate, at most a factor of e^2 away; the last where they don't shrink."""
    first, second = np.diff(np.log(path))
    rate = second / first if first else 0.0
    return max(path[-1] * float(np.exp(np.clip(second * rate / (1 - rate), -2, 2))), 1e-4) if 0 < rate < 1 else path[-1]


def _packed(data: DataFrame, terms: dict[str, list[str]], left_out: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """One row a subject, (fold, rows), written: for each combination of features that it has, the sum of its responses (null if one is), their number and the features, end to end; and each feature's place there."""
    at = {f: i for i, f in enumerate(dict.fromkeys(f for names in terms.values() for f in names), 2)}
    fold = F.min("fold") if left_out else F.lit(None)
    names = [f"f{i}" for i in at.values()]
    of_subject = data.select("subject", F.col("y").cast("double").alias("y"), *["fold"][: bool(left_out)], *[F.col(f).cast("double").alias(name) for f, name in zip(at, names, strict=True)])
    y = F.when(F.count("y") == F.count("*"), F.sum("y"))
    alike = of_subject.groupBy("subject", *names).agg(fold.cast("int").alias("fold"), y.alias("y"), F.count("*").cast("double").alias("trials"))
    rows = F.flatten(F.collect_list(F.array("y", "trials", *names)))
    return staged(alike.groupBy("subject").agg(F.min("fold").alias("fold"), rows.alias("rows")).select("fold", "rows")), at


def _tables(batch: pa.RecordBatch, width: int, rows: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, first row, rows x width table) of some of a batch's subjects at a time: as many as have `rows` rows together, one at least; a fold of -1 is none."""
    column, rows = batch.column("rows"), rows or _ROWS
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), (column.offsets.to_numpy() - column.offsets[0].as_py()) // width
    fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(fold):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + rows, "right")) - 1)
        yield fold[i:j], ends[i:j] - ends[i], flat[ends[i] : ends[j]]
        i = j


def _round(packed: DataFrame, at: dict[str, int], now: dict[str, tuple], terms: dict[str, list[str]], left_out: dict[str, int], part: Callable[..., np.ndarray]) -> dict[str, np.ndarray]:
    """Sum over subjects of part(x, y, first rows, *now[model], trials) for every model in `now`."""
    columns = {m: [at[f] for f in terms[m]] for m in now}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for fold, first, table in _tables(batch, len(at) + 2):
                for m, values in now.items():
                    begin, own = first, table
                    if m in left_out and (out := fold == left_out[m]).any():
                        size = np.diff(first, append=len(table))
                        own, size = table[~np.repeat(out, size)], size[~out]
                        begin = np.cumsum(size) - size
                    if len(begin):
                        x = np.column_stack([np.ones(len(own)), own[:, columns[m]]])
                        sums[m] = sums.get(m, 0.0) + part(x, own[:, 0], begin, *values, trials=own[:, 1])
        yield pa.RecordBatch.from_pydict({"model": pa.array(list(sums), pa.string()), "stats": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    return summed(packed.mapInArrow(step, "model string, stats array<double>"))


def fit(data: DataFrame, terms: dict[str, list[str]], prior_sd: float = 2.0, rounds: int = 25, tol: float = 1e-6, left_out: dict[str, int] | None = None, fallback: bool = False) -> dict[str, dict]:
    """(subject, y, features) -> model -> coef, sd, random_sd, log_likelihood, log_evidence, gradient, converged, method; each model has an intercept first.

    Fixed effects have N(0, prior_sd^2) priors; the intercepts' variance is
    moved to the mean second moment of their posteriors in each round, and in
    every second round as far ahead as the last moves point.  `converged` tells
    whether a model's steps fell under the tolerance within `rounds`.  A
    model in `left_out` is fitted without the subjects of that `fold`.  With
    `fallback` models that did not settle are fitted by `variational` instead
    (method "variational", others "newton"), and so are all others' evidences
    then, as those of two methods cannot be compared.
    """
    left_out = left_out or {}
    beta = {m: np.zeros(len(f) + 1) for m, f in terms.items()}
    var = dict.fromkeys(terms, 1.0)
    trail = {m: [1.0] for m in terms}
    out: dict[str, dict] = {}
    live = set(terms)
    packed, at = _packed(data, terms, left_out)
    for _ in range(rounds):
        for m, s in _round(packed, at, {m: (beta[m], var[m]) for m in live}, terms, left_out, batch_stats).items():
            n = len(beta[m])
            gradient = s[:n] - beta[m] / prior_sd**2
            hessian = s[n : n + n * n].reshape(n, n) + np.eye(n) / prior_sd**2
            move = np.linalg.solve(hessian, gradient)
            evidence = s[-3] + s[-4] - beta[m] @ beta[m] / (2 * prior_sd**2) - 0.5 * np.linalg.slogdet(hessian * prior_sd**2)[1]
            out[m] = {"coef": beta[m].copy(), "sd": np.sqrt(np.diag(np.linalg.inv(hessian))), "random_sd": float(np.sqrt(var[m])), "log_likelihood": float(s[-3]), "log_evidence": float(evidence), "gradient": gradient, "converged": False, "method": "newton"}
            moved = s[-2] / s[-1]
            if np.abs(move).max() < tol and abs(moved - var[m]) < 1e-4:
                out[m]["converged"] = True
                live.discard(m)
            beta[m] = beta[m] + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
            trail[m].append(max(float(moved), 1e-4))
            var[m] = trail[m][-1]
            if len(trail[m]) == 3:
                var[m] = _ahead(trail[m])
                trail[m] = [var[m]]
        if not live:
            break
    if fallback and live:
        bound = _variational(packed, at, terms, left_out, prior_sd)
        for m, found in bound.items():
            out[m] = found if m in live else out[m] | {"log_evidence": found["log_evidence"]}
    return out


def variational(data: DataFrame, terms: dict[str, list[str]], prior_sd: float = 2.0, rounds: int = 300, tol: float = 1e-6, left_out: dict[str, int] | None = None) -> dict[str, dict]:
    """As `fit`, by the variational bound: normal posterior of the coefficients, `log_evidence` is the bound, `bounds` its value in each round.

    `converged` tells whether the bound rose by less than `tol` (of its size)
    within `rounds`.
    """
    packed, at = _packed(data, terms, left_out or {})
    return _variational(packed, at, terms, left_out or {}, prior_sd, rounds, tol)


def _variational(packed: DataFrame, at: dict[str, int], terms: dict[str, list[str]], left_out: dict[str, int], prior_sd: float, rounds: int = 300, tol: float = 1e-6) -> dict[str, dict]:
    now = {m: (np.zeros(len(f) + 1), np.eye(len(f) + 1), 1.0) for m, f in terms.items()}
    out: dict[str, dict] = {m: {"bounds": []} for m in terms}
    live = set(terms)
    for _ in range(rounds):
        for m, s in _round(packed, at, {m: now[m] for m in live}, terms, left_out, batch_bound).items():
            n = len(now[m][0])
            precision = s[n : n + n * n].reshape(n, n) + np.eye(n) / prior_sd**2
            cov = np.linalg.inv(precision)
            mean = cov @ s[:n]
            bound = float(s[-3] + 0.5 * s[:n] @ mean - 0.5 * np.linalg.slogdet(precision * prior_sd**2)[1])
            bounds = [*out[m]["bounds"], bound]
            settled = len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tol * (1 + abs(bound))
            out[m] = {"coef": mean, "sd": np.sqrt(np.diag(cov)), "random_sd": float(np.sqrt(now[m][2])), "log_likelihood": None, "log_evidence": bound, "converged": settled, "method": "variational", "bounds": bounds}
            moment = s[-2] + s[n + n * n : 2 * n + n * n] @ mean + (s[2 * n + n * n : -3].reshape(n, n) * (cov + np.outer(mean, mean))).sum()
            now[m] = (mean, cov, max(float(moment / s[-1]), 1e-4))
            if settled:
                live.discard(m)
        if not live:
            break
    return out


def term_table(spark, fitted: dict[str, dict], terms: dict[str, list[str]]) -> DataFrame:
    """model_id, term, coef, sd, converged: the input of the posterior summary."""
    rows = [(m, t, float(c), float(s), r["converged"]) for m, r in fitted.items() for t, c, s in zip(["intercept", *terms[m]], r["coef"], r["sd"])]
    return spark.createDataFrame(rows, "model_id string, term string, coef double, sd double, converged boolean")


def evidence_table(spark, fitted: dict[str, dict], terms: dict[str, list[str]], null: str) -> DataFrame:
    """The term table with method, log_evidence and evidence_gain, a model's log evidence less that of the simpler model `null`."""
    rows = [(m, r["method"], r["log_evidence"], r["log_evidence"] - fitted[null]["log_evidence"]) for m, r in fitted.items()]
    known = spark.createDataFrame(rows, "model_id string, method string, log_evidence double, evidence_gain double")
    return term_table(spark, fitted, terms).join(F.broadcast(known), "model_id")  # a row for each model


def feature_sweep(features: list[str], lags: list[str], group: str = "group_coded") -> dict[str, list[str]]:
    """Terms of one model for each feature with its interaction with the group, of one with all, and of the group alone ("null")."""
    single = {f: [group, f, f"group_{f}_interaction", *lags] for f in features}
    everything = [group, *features, *[f"group_{f}_interaction" for f in features], *lags]
    return single | {"all": everything, "null": [group]}


def leave_out(data: DataFrame, names: list[str], folds: list[int], **options) -> DataFrame:
    """Coefficients of one model refitted without each fold (column `fold`, from 0): fold, term, coef, sd, converged, all folds in the same jobs."""
    models = {str(f): f for f in folds}
    terms = dict.fromkeys(models, names)
    table = term_table(data.sparkSession, fit(data, terms, left_out=models, **options), terms)
    return table.select(F.col("model_id").cast("int").alias("fold"), "term", "coef", "sd", "converged")


def leave_one_out(data: DataFrame, names: list[str], prior_sd: float = 2.0, **options) -> DataFrame:
    """(subject, fold, y, features) -> fold, term, coef, sd, converged (of the full fit): the model without each fold, by subtraction.

    The full model is fitted once.  A fold's sums of gradient and Hessian at its
    solution are kept in a table; without them the total's next Newton step leads
    to the fold's coefficients up to the square of the fold's pull on them.  The
    intercepts' variance stays that of the full model.  Any number of folds costs
    one pass, and the driver holds the total alone.
    """
    terms = {"all": names}
    full = fit(data, terms, prior_sd, **options)["all"]
    packed, at = _packed(data, terms, {"all": -1})
    beta, var, columns = full["coef"], full["random_sd"] ** 2, [at[f] for f in names]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, first, table in _tables(batch, len(at) + 2):
                stats = batch_stats(np.column_stack([np.ones(len(table)), table[:, columns]]), table[:, 0], first, beta, var, each=True, trials=table[:, 1])
                yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int64()), "stats": pa.array(stats.tolist(), pa.list_(pa.float64()))})

    each = staged(packed.mapInArrow(own, "fold long, stats array<double>"))
    held = each.select("fold", F.posexplode("stats").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    by_fold = staged(held.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("stats")))
    total, n = summed(by_fold.select(F.lit(0).alias("model"), "stats"))[0], len(beta)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, stats in zip(pdf["fold"], pdf["stats"]):
                rest = total - np.asarray(stats)
                hessian = rest[n : n + n * n].reshape(n, n) + np.eye(n) / prior_sd**2
                coef = beta + np.linalg.solve(hessian, rest[:n] - beta / prior_sd**2)
                yield pd.DataFrame({"fold": fold, "term": ["intercept", *names], "coef": coef, "sd": np.sqrt(np.diag(np.linalg.inv(hessian))), "converged": full["converged"]})

    return by_fold.mapInPandas(solve, "fold long, term string, coef double, sd double, converged boolean")
