"""Readers, writers and parsed columns: explicit schemas, keys from paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_names, staged  # noqa: F401  (staged: also by this name)

WORDS = "onset double, onset_bin double, text string, pos string"
SEGMENTS = "onset_sec double, seg string, speaker string, actor string, main_char string"
RESPONSES = "participant string, rt string"


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", sep: str = ",", skip_rows: int = 0) -> DataFrame:
    """CSV with a header and a fixed schema; `skip_rows` drops rows after the header of each file by their place in it."""
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("sep", sep).csv(path)
    if not skip_rows:
        return df
    file, n, first = free_names(df, "file", "n", "first")
    placed = df.withColumns({file: F.input_file_name(), n: F.monotonically_increasing_id()})  # rows of a file ascend in the order of its lines
    rank = F.row_number().over(Window.partitionBy(file).orderBy(n))
    head = placed.groupBy(file).agg(F.min(n).alias(first))
    near = placed.join(head, file).filter(F.col(n) < F.col(first) + skip_rows).withColumn(first, rank)
    return placed.join(near.filter(F.col(first) <= skip_rows).select(file, n), [file, n], "left_anti").select(*df.columns)


def probe_encoding(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> str:
    """UTF-8 where every line under the path is valid UTF-8, else the fallback (any bytes are valid Latin-1); one pass, one value."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return fallback if bad.count() else "UTF-8"


def read_csv_probed(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """`read_csv` in the encoding that `probe_encoding` finds."""
    return read_csv(spark, path, schema, encoding=probe_encoding(spark, path), **options)


def read_keyed(spark: SparkSession, path: str, pattern: str, *names: str) -> DataFrame:
    """Parquet files whose names carry keys: one column for each group of the pattern."""
    df = spark.read.parquet(path)
    return df.withColumns({n: F.regexp_extract(F.input_file_name(), pattern, i + 1) for i, n in enumerate(names)})


def write_stage(df: DataFrame, path: str, *by: str, kind: str = "parquet") -> None:
    """A stage's result, partitioned by its keys."""
    df.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def parse_list(text: Column) -> Column:
    """A written list of numbers as an array."""
    return F.from_json(text, "array<double>")


def label_token(name: Column, place: int, sep: str = "_") -> Column:
    """The place-th (from 0) token of a label."""
    return F.get(F.split(name, sep), F.lit(place))


def model_states(name: Column) -> Column:
    """Number of states in a model's name ("<group>_<n>states" or "<n>_states")."""
    return F.regexp_extract(name, r"(\d+)_?states", 1).cast("int")


def read_line_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Label files of two-line records: (file, record, first, second).  Such files are short, so each is read as one text."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("pos", "line"))
    return lines.groupBy("file", F.floor(F.col("pos") / 2).alias("record")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("line"))).alias("first"), F.max(F.when(F.col("pos") % 2 == 1, F.col("line"))).alias("second")).filter("first <> ''")


def prefixed(name: Column, prefix: str = "sub-") -> Column:
    """The name with the prefix, put only where it is missing."""
    return F.when(name.startswith(prefix), name).otherwise(F.concat(F.lit(prefix), name))


def threshold_token(threshold: Column) -> Column:
    """A threshold as three digits of hundredths, for names: 0.8 is 080."""
    return F.lpad(F.round(threshold * 100).cast("int").cast("string"), 3, "0")


def cohort(spark: SparkSession, members: dict[str, str]) -> DataFrame:
    """(subject, grp) from one written list of ids for each group, parted by commas (as an environment variable holds it); blanks and empty ids don't count."""
    rows = [(s.strip(), g) for g, ids in members.items() for s in ids.split(",") if s.strip()]
    return spark.createDataFrame(rows, "subject string, grp string").distinct()


def cohort_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.[^/.]*$") -> DataFrame:
    """(subject, grp) from files of one id a line; the group is what the pattern finds in the file's path."""
    ids = spark.read.text(path).select(F.trim("value").alias("subject"), F.regexp_extract(F.input_file_name(), pattern, 1).alias("grp"))
    return ids.filter("subject <> ''").distinct()


def complete(keys: DataFrame, *required: DataFrame, on: list[str]) -> DataFrame:
    """Keys that every required table has, with the columns of all: a model that lacks one is skipped."""
    for table in required:
        keys = keys.join(table, on)
    return keys


def enriched(keys: DataFrame, *tables: DataFrame, on: list[str]) -> DataFrame:
    """Keys with what each table has for them; null where it has nothing."""
    for table in tables:
        keys = keys.join(table, on, "left")
    return keys
