"""Planning helpers of the corpus operators, over the library's shared-folder tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import free_names, numbered, shared_dir  # noqa: F401
from ..sources.shared import staged as written  # noqa: F401


def spread_of(spark: SparkSession) -> int:
    """Number of hash ranges that an order over a hot key is cut into; follows the session's parallelism."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_key(*columns, ranges: int):
    """Hash range of a row: a hot key's rows go to `ranges` groups, whose totals are then laid end to end."""
    return F.pmod(F.xxhash64(*columns), F.lit(ranges)).cast("int")


def over_cores(docs: DataFrame) -> DataFrame:
    """The same rows, dealt anew where the scan has fewer parts than the session has cores (a single small file); other scans stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
