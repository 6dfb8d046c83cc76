"""Checks of fitted hidden-state models on their parameters (k d^2 numbers): distances, mixing, reliability over folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import blocked, tiles
from .hmm import Params


def separability(spark: SparkSession, p: Params, weight: np.ndarray | None = None) -> DataFrame:
    """Euclidean and Mahalanobis distance of every two states' means, under their mean covariance (by weight; ridged where nearly singular)."""
    share = np.full(p.k, 1 / p.k) if weight is None else weight / weight.sum()
    pooled = np.einsum("k,kij->ij", share, p.cov)
    if np.linalg.eigvalsh(pooled).min() < 1e-6:
        pooled = pooled + 1e-6 * np.eye(len(pooled))
    rows = []
    for a in range(p.k):
        for b in range(a + 1, p.k):
            gap = p.mean[a] - p.mean[b]
            rows.append((a, b, float(np.sqrt(gap @ gap)), float(np.sqrt(gap @ np.linalg.solve(pooled, gap)))))
    return spark.createDataFrame(rows, "a int, b int, euclidean double, mahalanobis double")


def mixing_rate(transition: np.ndarray) -> float:
    """1 - modulus of the second largest eigenvalue; 1 for a single state."""
    size = np.sort(np.abs(np.linalg.eigvals(transition)))
    return float(1 - size[-2]) if len(size) > 1 else 1.0


def stability(spark: SparkSession, p: Params, scores: Sequence[float] = ()) -> DataFrame:
    """Mixing rate, mean condition number of the covariances, and 1 - deviation / |mean| of the restarts' scores (null for none)."""
    spread = float(1 - np.std(scores) / abs(np.mean(scores))) if len(scores) and np.mean(scores) else None
    row = (mixing_rate(p.transition), float(np.mean(np.linalg.cond(p.cov))), spread)
    return spark.createDataFrame([row], "mixing_rate double, mean_condition double, init_stability double")


def confusion_entropy(probability: np.ndarray) -> float:
    """Mean over decoded states of the entropy (bits) of their mean posteriors."""
    q = np.where(probability > 0, probability, 1.0)
    return float(-(q * np.log2(q)).sum() / len(q))


def best_matching(gain: np.ndarray) -> np.ndarray:
    """Column for each row so that the summed gain is largest: exact, by shortest augmenting paths (k^3 steps)."""
    k = len(gain)
    cost = gain.max(initial=0.0) - gain
    row_price, col_price, row_of = np.zeros(k), np.zeros(k), np.full(k, -1)
    for row in range(k):
        far, came, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        now, at, length = row, -1, 0.0
        while True:  # grow a tree of tight edges from `row` until it meets a free column
            step = length + cost[now] - row_price[now] - col_price
            nearer = ~done & (step < far)
            far[nearer], came[nearer] = step[nearer], at
            at = int(np.argmin(np.where(done, np.inf, far)))
            length = far[at]
            done[at] = True
            if row_of[at] < 0:
                break
            now = int(row_of[at])
        for c in np.flatnonzero(done):
            if row_of[c] >= 0:
                row_price[row_of[c]] += length - far[c]
            col_price[c] -= length - far[c]
        row_price[row] += length
        while at >= 0:  # turn the path round
            before = int(came[at])
            row_of[at] = row if before < 0 else row_of[before]
            at = before
    out = np.empty(k, int)
    out[row_of] = np.arange(k)
    return out


def fold_reliability(means: DataFrame, floor: float = 1e-12, block_rows: int | None = None) -> DataFrame:
    """(fold, state, x array) -> fold, reliability, n_pairs: mean cosine of a fold's states with those of every other fold, best matched.

    A fold is one row, dealt to the tasks of its block with every other block;
    a task gives one row for each of its folds, never one for a pair.  The mean over
    folds, weighted by n_pairs, is that over all pairs.
    """
    row = F.sort_array(F.collect_list(F.struct("state", "x")))
    vectors = means.groupBy(F.col("fold").alias("id")).agg(row.alias("r")).select("id", F.col("r.state").alias("at"), F.flatten("r.x").alias("v"))

    def run(ids, at, v, i, j) -> Iterator[dict]:
        states = {len(s) for s in at}
        pattern = [np.asarray(x, float).reshape(len(s), -1) for s, x in zip(at, v)]
        pattern = [x / (np.linalg.norm(x, axis=1, keepdims=True) + floor) for x in pattern]
        total, n = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        if len(states) == 1 and (k := states.pop()) <= 4:  # all matchings of all pairs side by side
            stacked = np.stack(pattern)
            for some in tiles(i, j):
                cosine = [[stacked[some, r] @ stacked[j, c].T for c in range(k)] for r in range(k)]
                matched = reduce(np.maximum, (sum(cosine[r][c] for r, c in enumerate(order)) for order in permutations(range(k)))) / k
                once = some[:, None] < j[None, :] if np.array_equal(i, j) else np.ones(matched.shape, bool)
                matched = np.where(once, matched, 0.0)
                for axis, rows in ((1, some), (0, j)):
                    total[rows] += matched.sum(axis)
                    n[rows] += once.sum(axis)
        else:
            for x in i:
                for y in j:
                    if x < y or not np.array_equal(i, j) and x != y:
                        cosine = pattern[x] @ pattern[y].T
                        matched = cosine[np.arange(len(cosine)), best_matching(cosine)].mean()
                        total[[x, y]] += matched
                        n[[x, y]] += 1
        seen = np.flatnonzero(n)
        yield {"a": ids[seen], "b": ids[seen], "total": total[seen], "n": n[seen]}

    sums = blocked(vectors, run, "total double, n long", block_rows)
    return sums.groupBy(F.col("a").alias("fold")).agg((F.sum("total") / F.sum("n")).alias("reliability"), F.sum("n").alias("n_pairs"))


def reliability(means: Sequence[np.ndarray], floor: float = 1e-12) -> float:
    """Mean over pairs of folds of the cosine of their best matched states; 1 for a single fold."""
    found = []
    for i, a in enumerate(means):
        for b in means[i + 1 :]:
            cosine = a @ b.T / ((np.linalg.norm(a, axis=1)[:, None] + floor) * (np.linalg.norm(b, axis=1)[None] + floor))
            found.append(cosine[np.arange(len(a)), best_matching(cosine)].mean())
    return float(np.mean(found)) if found else 1.0
