"""Linear algebra of many small models at once: one row a model, batches of equal size solved together in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_moments(obs: DataFrame, d: int, key: str = "subject") -> DataFrame:
    """(key, state, x array of d) -> key, state, n, mean, cov (row by row): one pass, d (d + 3) / 2 sums a state, combined before the shuffle."""
    x = [F.get("x", F.lit(i)) for i in range(d)]
    upper = {(i, j): f"_c{i}_{j}" for i in range(d) for j in range(i, d)}
    sums = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(name) for (i, j), name in upper.items()]
    mean, cov = F.array(*[f"_m{i}" for i in range(d)]), F.array(*[upper[min(i, j), max(i, j)] for i in range(d) for j in range(d)])
    return obs.groupBy(key, "state").agg(F.count("*").alias("n"), *sums).select(key, "state", "n", mean.alias("mean"), cov.alias("cov"))


def _by_size(sizes: pd.Series) -> Iterator[np.ndarray]:
    for size in sizes.unique():
        yield np.flatnonzero(sizes.to_numpy() == size)


def separability(moments: DataFrame, key: str = "subject", ridge: float = 1e-6) -> DataFrame:
    """(key, state, n, mean, cov) -> key, a < b, euclidean, mahalanobis: every two states of a model under its mean covariance, weighted by n.

    The mean covariance gets `ridge` on its diagonal where its least eigenvalue
    is under that.  A model with one state has no row.
    """
    kind = moments.schema[key].dataType.simpleString()
    state = moments.schema["state"].dataType.simpleString()
    model = moments.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("state", "n", "mean", "cov"))).alias("s"))
    flat = model.select("key", F.col("s.state").alias("state"), F.col("s.n").alias("n"), F.flatten("s.mean").alias("mean"), F.flatten("s.cov").alias("cov"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in _by_size(pdf["state"].map(len)):
                part = pdf.iloc[at]
                k = len(part["state"].iloc[0])
                n, mean = np.stack(part["n"]).astype(float), np.stack(part["mean"]).reshape(len(at), k, -1)
                d = mean.shape[2]
                cov = np.einsum("mk,mkij->mij", n / n.sum(1, keepdims=True), np.stack(part["cov"]).reshape(len(at), k, d, d))
                cov = cov + np.where(np.linalg.eigvalsh(cov)[:, :1, None] < ridge, ridge, 0.0) * np.eye(d)
                low = np.linalg.cholesky(cov)
                a, b = np.triu_indices(k, 1)
                gap = mean[:, a] - mean[:, b]
                scaled = np.linalg.solve(low, gap.transpose(0, 2, 1))
                names = np.stack(part["state"])
                length = lambda v, axis: np.sqrt((v**2).sum(axis)).ravel()
                yield pd.DataFrame({key: np.repeat(part["key"].to_numpy(), len(a)), "a": names[:, a].ravel(), "b": names[:, b].ravel(), "euclidean": length(gap, 2), "mahalanobis": length(scaled, 1)})

    return flat.mapInPandas(run, f"{key} {kind}, a {state}, b {state}, euclidean double, mahalanobis double")


def mixing(moves: DataFrame, k: int, key: str = "subject") -> DataFrame:
    """(key, before, after, n) over states 0..k-1 -> key, second (modulus of the second largest eigenvalue of the transition matrix), mixing_rate (1 - second).

    A state that is never left keeps itself; with one state the rate is 1.
    """
    kind = moves.schema[key].dataType.simpleString()
    model = moves.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(F.col("before").cast("int").alias("before"), F.col("after").cast("int").alias("after"), F.col("n").cast("double").alias("n"))).alias("m"))
    flat = model.select("key", F.col("m.before").alias("before"), F.col("m.after").alias("after"), F.col("m.n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            count = np.zeros((len(pdf), k, k))
            for i, r in enumerate(pdf.itertuples(index=False)):
                np.add.at(count[i], (r.before, r.after), r.n)
            left = count.sum(2, keepdims=True)
            matrix = np.where(left > 0, count / np.maximum(left, 1), np.eye(k))
            size = np.sort(np.abs(np.linalg.eigvals(matrix)), axis=1)
            second = size[:, -2] if k > 1 else np.zeros(len(pdf))
            yield pd.DataFrame({key: pdf["key"], "second": second, "mixing_rate": 1 - second})

    return flat.mapInPandas(run, f"{key} {kind}, second double, mixing_rate double")
