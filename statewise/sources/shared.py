"""Tables in the folder that driver and executors share, and orders over whole tables that need no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a fresh local one, but only for a local master: on a
    cluster other machines could not read it, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends there, lost executors cost no recomputation.

    The tables are left to whoever set the folder, since results are lazy and
    may be read at any later time.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that `df` does not have (in any case), one for each wanted."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return out


def _sorted_parts(df: DataFrame, at: str, part: str, *order: Column) -> DataFrame:
    """A range sort, written, with each row's place in its sorted part."""
    placed = staged(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    return placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """`df` with its places 0, 1, ... in the order: the sorted parts' sizes are laid end to end (one row for each part)."""
    at, part = free_names(df, "at", "part")
    placed = _sorted_parts(df, at, part, *order)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias(name))
    return placed.join(before, part).select(*df.columns, (F.col(name) + F.col(at)).alias(name))


def running(df: DataFrame, value: Column, *order: Column, total: str = "running", count: str = "number") -> DataFrame:
    """`df` with the sum of `value` and the number of rows up to each row, itself included, in the order."""
    at, part, v = free_names(df, "at", "part", "v")
    placed = _sorted_parts(df.withColumn(v, value), at, part, *order)
    sums = placed.groupBy(part).agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    before = W.orderBy(part)
    ahead = sums.select(part, (F.sum("n").over(before) - F.col("n")).alias("n"), (F.sum("s").over(before) - F.col("s")).alias("s"))
    inside = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(ahead, part).select(*df.columns, (F.col("s") + F.sum(v).over(inside)).alias(total), (F.col("n") + F.col(at) + 1).alias(count))


def scanned(df: DataFrame, found: dict[str, tuple[str, Column]], *order: Column) -> DataFrame:
    """`df` with columns (name -> (kind, value)) carried along the order over the whole table, each row itself included.

    Kinds: "last" (not null), "min", "max", and "previous", the row before's
    value.  Parts of a range sort are scanned each by itself; what the parts
    before one add is a row for each part.
    """
    names = free_names(df, "at", "part", *found)
    (at, part), values = names[:2], dict(zip(found, names[2:], strict=True))
    kinds = {name: kind for name, (kind, _) in found.items()}
    placed = _sorted_parts(df.withColumns({values[name]: value for name, (_, value) in found.items()}), at, part, *order)
    of_part = {
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))), "min": F.min, "max": F.max,
        "previous": lambda v: F.max_by(v, at),
    }
    before, inside, near = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(part).orderBy(at)
    of_before = {"last": lambda c: F.last(c, ignorenulls=True).over(before), "min": lambda c: F.min(c).over(before), "max": lambda c: F.max(c).over(before), "previous": lambda c: F.lag(c).over(W.orderBy(part))}
    ends = placed.groupBy(part).agg(*[of_part[kinds[name]](v).alias(v) for name, v in values.items()])
    ahead = ends.select(part, *[of_before[kinds[name]](v).alias(f"{v}_ahead") for name, v in values.items()])
    combined = {
        "last": lambda v: F.coalesce(F.last(v, ignorenulls=True).over(inside), f"{v}_ahead"),
        "min": lambda v: F.least(F.min(v).over(inside), f"{v}_ahead"), "max": lambda v: F.greatest(F.max(v).over(inside), f"{v}_ahead"),
        "previous": lambda v: F.when(F.col(at) == 0, F.col(f"{v}_ahead")).otherwise(F.lag(v).over(near)),
    }
    return placed.join(ahead, part).select(*df.columns, *[combined[kinds[name]](v).alias(name) for name, v in values.items()])
