"""Sums of statistics vectors that tasks emit, one vector per key: the reduction of every iterative fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(vectors: DataFrame, key: str = "model") -> dict:
    """(key, stats array) -> key -> elementwise sum; only keys x length numbers reach the driver."""
    long = vectors.select(key, F.posexplode("stats").alias("i", "v")).groupBy(key, "i").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in long.collect():
        out.setdefault(r[key], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}
