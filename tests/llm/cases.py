"""Rows that every operator must handle: nulls, empty and very long texts, ties, repeated rows, taken column names."""

from pyspark.sql import functions as F

#: Names that the operators use themselves.
NAMES = "id key leaf hash tie at part tree slot n up spot siblings parent path root subroot bits kind first component form output restored code h1 h2 row n_words tokens".split()
LONG = " ".join(f"x{i % 9973} Y{i * 7919 % 100_003}" for i in range(420_000))  # some 5 MB
ROWS = [
    (1, None, "s", None, None), (2, "", None, "a", 0), (3, " \n\t ", "s", "b", 4), (4, "One two three four", None, None, 18), (4, "One two three four", None, None, 18), (5, "one TWO three four", "", "c", 18),
    (None, "one two", "t", "d", 7), (None, None, None, None, None), (None, None, None, None, None), (6, LONG, "s", "e", len(LONG)), (7, "a<P>b c", "t", "f", 7), (8, "é" * 500 + "\U0001f600 x" * 300 + "\x00", "t", "g", 1),
    (9, "one", "t", "h", 3), (10, "<", "t", "h", 1), (12, "<P <S >M> <M", "t", "h", 12), (13, "one two three four five", "lone", "h", 23),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def frame(spark, sf="/root/testdata/sf0.001"):
    """The rows above and the small documents, with columns whose names are taken."""
    own = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "source", "lang", "CAST(n_chars AS long) AS n_chars")
    both = own.union(spark.createDataFrame(ROWS, SCHEMA))
    return both.withColumns({c: F.lit(7) for c in NAMES}).repartition(5).cache()
