"""Responses and annotations on common bins: agreement, snapping, interval joins, peaks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import bin_floor, bin_half_even
from ..sources.shared import free_names, scanned


def response_bins(rt: DataFrame, width: float, key: str = "participant") -> DataFrame:
    """Distinct (participant, bin) of response times; rows without a time are dropped."""
    return rt.na.drop(subset=["rt"]).select(key, bin_half_even(F.col("rt"), width).alias("bin")).distinct()


def semi_join(rt: DataFrame, registry: DataFrame, key: str = "participant") -> DataFrame:
    return rt.na.drop(subset=["rt"]).join(registry.select(key), key, "left_semi")


#: Bins of a story that count, by unit (first, first that no longer counts).
UNIT_RANGES = {"TR": (14, 466), "second": (21, 699)}


def agreement(bins: DataFrame, key: str = "participant", within: tuple[int, int] | None = None) -> DataFrame:
    """Participants per observed bin, as a count and a share of all; bins without a response have no row.

    With `within` (see `UNIT_RANGES`) only bins from the first up to, and
    without, the second are given; the share is still of all participants.
    """
    total = bins.agg(F.count_distinct(key).alias("n"))
    if within is not None:
        bins = bins.filter((F.col("bin") >= within[0]) & (F.col("bin") < within[1]))
    return bins.groupBy("bin").agg(F.count_distinct(key).alias("count")).join(F.broadcast(total)).select("bin", "count", (F.col("count") / F.col("n")).alias("agreement"))


def boundary_snap(points: DataFrame, boundaries: DataFrame, delta: int, p: str = "bin", b: str = "boundary") -> DataFrame:
    """Each point to the boundary at or before it: exact, or at most delta after it.

    Null at or before the first boundary and after the last.  As-of by one scan
    over the sorted parts of the union of both sides.
    """
    edges = boundaries.agg(F.min(b).alias("first"), F.max(b).alias("last"))
    both = points.select(F.col(p).alias("at"), F.lit(None).cast("int").alias("edge"), F.struct(*points.columns).alias("row"))
    both = both.unionByName(boundaries.select(F.col(b).cast("int").alias("at"), F.col(b).cast("int").alias("edge")).distinct(), allowMissingColumns=True)
    found = scanned(both, {"before": ("last", F.col("edge"))}, F.col("at"), F.col("edge").isNull()).filter("row is not null").join(F.broadcast(edges))  # one row
    inside = (F.col("at") > F.col("first")) & (F.col("at") <= F.col("last")) & (F.col("at") - F.col("before") <= delta)
    return found.select("row.*", F.when(inside, F.col("before")).alias("snapped"))


def agreement_snapped(snapped: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts summed at the snapped bins, as a share of the participants with a response."""
    n = responses.agg(F.count_distinct("participant").cast("double").alias("n"))
    sums = snapped.filter("snapped is not null").groupBy("snapped").agg(F.sum("count").alias("count"))
    return sums.join(F.broadcast(n)).select("snapped", "count", (F.col("count") / F.col("n")).alias("agreement"))  # n is one row


def asof_segment(words: DataFrame, segments: DataFrame, key: str = "story") -> DataFrame:
    """Each word with the last segment that starts at or before it; words before the first are dropped.

    One window per story over words and segment starts together, no range join.
    A segment's columns are its own but for those that words have too.
    """
    w_cols = [c for c in words.columns if c not in (key, "onset")]
    s_cols = [c for c in segments.columns if c not in (key, *w_cols)]
    w_rows = words.select(key, "onset", F.lit(1).alias("kind"), F.struct(*w_cols).alias("word"))
    s_rows = segments.select(key, F.col("onset_sec").alias("onset"), F.lit(0).alias("kind"), F.struct(*s_cols).alias("segment"))
    both = w_rows.unionByName(s_rows, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("onset", "kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("segment", F.last("segment", ignorenulls=True).over(w)).filter("kind = 1 and segment is not null").select(key, "onset", "word.*", "segment.*")


def word_flags(words: DataFrame, speaker: str, tags: dict[str, str], together: dict[str, tuple[str, ...]] | None = None, actors: str = "actor") -> DataFrame:
    """Dialog and speaker flags of words in segments, one flag for each part of speech, and one for each set of names that all occur in the lower-cased list of actors."""
    present = lambda names: reduce(Column.__and__, [F.coalesce(F.lower(actors).contains(n.lower()), F.lit(False)) for n in names])
    flags = {"is_dialog": F.col("speaker").isNotNull(), f"{speaker}_speaking": F.coalesce(F.lower("speaker").contains(speaker.lower()), F.lit(False))}
    return words.withColumns(flags | {f"is_{n}": F.col("pos") == t for n, t in tags.items()} | {n: present(names) for n, names in (together or {}).items()})


def bin_majority(words: DataFrame, flags: list[str], width: float, key: str = "story", lists: dict[str, str] | None = None, modes: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """Fixed bins from each story's first onset: majority of each flag, any, counts, ordered words, first segment, commonest value of each of `modes` (ties to the least).

    `lists` (name -> flag) adds the words of a bin that have a flag, in order.
    """
    start = F.min("onset").over(W.partitionBy(key))
    binned = words.withColumn("bin", bin_floor(F.col("onset") - start, width))
    parts = []
    for f in flags:
        parts += [(F.avg(F.col(f).cast("double")) > 0.5).alias(f"mostly_{f}"), F.max(f).alias(f"has_{f}"), F.sum(F.col(f).cast("int")).alias(f"n_{f}")]
    kept = F.struct("onset", "word_id", "text", *[F.col(f).alias(f"in_{n}") for n, f in (lists or {}).items()])
    in_order = F.array_sort(F.collect_list(kept)).alias("held")
    grouped = binned.groupBy(key, "bin").agg(*parts, in_order, F.min_by("seg", F.struct("onset", "word_id")).alias("segment_text"), *[F.mode(c, True).alias(c) for c in modes])
    texts = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), " ")
    of = lambda name: F.filter("held", lambda x: F.coalesce(x[f"in_{name}"], F.lit(False)))
    chosen = {n: texts(of(n)) for n in lists or {}}
    return grouped.withColumns({"words": texts(F.col("held"))} | chosen).drop("held")


def dense_bins(binned: DataFrame, size: int | DataFrame, key: str = "story", tolerance: int = 10, force: bool = False) -> DataFrame:
    """Every (key, bin 0..size-1): bins without a word have false flags, counts of 0, empty lists of words and "none" for names.

    `size` is one number for all or a table (key, size).  A story whose own number
    of bins is more than `tolerance` away from it is an error unless `force` is
    given; within it, bins past the expected ones stay.
    """
    own = binned.groupBy(key).agg((F.max("bin") + 1).alias("n"))
    sizes = own.withColumn("size", F.lit(size)) if isinstance(size, int) else own.join(size.select(key, "size"), key, "left")
    if not force:
        off = sizes.filter(F.coalesce(F.abs(F.col("n") - F.col("size")) > tolerance, F.lit(True))).limit(1).collect()
        if off:
            raise ValueError(f"{off[0][key]} has {off[0]['n']} bins, {off[0]['size']} are expected")
    last = F.greatest("n", "size") - 1
    cells = sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin"))
    kinds = dict(binned.dtypes)
    empty = {"boolean": False, "string": "none", "int": 0, "bigint": 0, "double": 0.0}
    fill = {c: "" if c in ("words", "segment_text") else empty[kinds[c]] for c in binned.columns if c not in (key, "bin") and kinds[c] in empty}
    return cells.join(binned, [key, "bin"], "left").na.fill(fill)


def windows_between(boundaries: DataFrame, key: str, b: str = "boundary", start: float = 0.0) -> DataFrame:
    """Boundaries of a key as windows (begin, end); the first begins at `start`."""
    w = W.partitionBy(key).orderBy(b)
    return boundaries.select(key, F.coalesce(F.lag(b).over(w), F.lit(start)).alias("begin"), F.col(b).alias("end"))


def events_to_text(words: DataFrame, windows: DataFrame, key: str = "story", closed: str = "both", width: float = 60.0) -> DataFrame:
    """Words of each window in order, joined by blanks; `closed` tells which ends belong to a window ("both", "left", "right").

    Windows are laid over buckets of `width`, so a word meets only the windows
    of its bucket, however many a story has.
    """
    if closed not in ("both", "left", "right"):
        raise ValueError(f"closed is {closed!r}")
    bucket = lambda c: F.floor(F.col(c) / width)
    laid = windows.filter(F.col("begin") <= F.col("end")).withColumn("bucket", F.explode(F.sequence(bucket("begin"), bucket("end"))))
    after = F.col("onset") > F.col("begin") if closed == "right" else F.col("onset") >= F.col("begin")
    before = F.col("onset") < F.col("end") if closed == "left" else F.col("onset") <= F.col("end")
    found = laid.join(words.withColumn("bucket", bucket("onset")), [key, "bucket"]).filter(after & before)
    in_order = F.array_sort(F.collect_list(F.struct("onset", "word_id", "text")))
    return found.groupBy(key, "begin", "end").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), " ").alias("text"))


def events_to_segments(segments: DataFrame, windows: DataFrame, key: str = "story") -> DataFrame:
    """Segments from the one begun at or before a window's begin up to, and without, the one in progress at its end.

    Both edges are found as of their time in one window over a story's
    segments and edges; segments then meet by number.
    """
    own = W.partitionBy(key).orderBy("onset_sec", "seg_id")
    numbered = segments.withColumn("i", F.row_number().over(own))
    starts = numbered.select(key, F.col("onset_sec").alias("at"), F.lit(1).alias("kind"), "i")
    edge = lambda c, kind: windows.select(key, F.col(c).alias("at"), F.lit(kind).alias("kind"), "begin", "end")
    # an end comes before the segments of its time, a begin after them
    both = starts.unionByName(edge("end", 0), allowMissingColumns=True).unionByName(edge("begin", 2), allowMissingColumns=True)
    so_far = W.partitionBy(key).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    known = both.withColumn("last", F.max("i").over(so_far)).filter("kind <> 1")
    edges = known.groupBy(key, "begin", "end").agg(F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("lo"), F.max(F.when(F.col("kind") == 0, F.col("last"))).alias("hi"))
    wanted = edges.filter("lo < hi").withColumn("i", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    found = wanted.join(numbered.select(key, "i", "seg"), [key, "i"])
    in_order = F.array_sort(F.collect_list(F.struct("i", "seg")))
    return found.groupBy(key, "begin", "end").agg(F.array_join(F.transform(in_order, lambda x: x["seg"]), " ").alias("text"), F.count("*").alias("n_segments"))


def _prominences(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, prominence) of the local maxima; each side's base is the least value up to the nearest higher place, kept on a stack."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    flat, last = v[first], np.concatenate([first[1:], [len(v)]]) - 1

    def bases(x: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(x)), []  # (value, least value since the higher one before it)
        for i, value in enumerate(x):
            low = value
            while stack and stack[-1][0] <= value:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((value, low))
        return out

    top = np.flatnonzero((flat[1:-1] > flat[:-2]) & (flat[1:-1] > flat[2:])) + 1
    base = np.maximum(bases(flat), bases(flat[::-1])[::-1])
    return (first[top] + last[top]) // 2, flat[top] - base[top]


def peaks(series: DataFrame, order: str = "bin", value: str = "agreement", by: str | None = None) -> DataFrame:
    """Local maxima of each series in index space with their prominence; plateaus count at their middle, ends never.

    A series (all rows, or those of a key) is one group: a curve of as many
    places as there are bins, whatever the events behind it.
    """
    (key,) = free_names(series, "series") if by is None else (by,)
    held = series.select(F.lit(0).alias(key) if by is None else F.col(by), F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    kinds = dict(held.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        place, prominence = _prominences(pdf["v"].to_numpy())
        at = pdf.iloc[place]
        return pd.DataFrame({key: at[key], "at": at["at"], "v": at["v"], "prominence": prominence})

    found = held.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, at {kinds['at']}, v double, prominence double")
    return found.select(*([key] if by else []), F.col("at").alias(order), F.col("v").alias(value), "prominence")


def threshold_sweep(found: DataFrame, series: DataFrame, value: str = "agreement", step: float = 0.01, by: str | None = None) -> DataFrame:
    """Number of peaks at each prominence threshold of a grid between the 85 % and 95 % quantiles of each series; prominences are computed once.

    Values are shares, so a grid has at most 1 / step places, which go to every task.
    """
    keys = [by] if by else []
    grid = series.groupBy(*keys).agg(F.round(F.percentile(value, 0.85), 2).alias("a"), F.round(F.percentile(value, 0.95), 2).alias("b"))
    low, high = F.round((F.col("a") - 0.05) / step).cast("int"), F.round(F.col("b") / step).cast("int")
    steps = grid.select(*keys, F.explode(F.sequence(low, high)).alias("k")).withColumn("threshold", F.round(F.col("k") * step, 2)).drop("k")
    met = found.join(steps, by) if by else found.join(F.broadcast(steps))
    counts = met.filter(F.col("prominence") >= F.col("threshold")).groupBy(*keys, "threshold").agg(F.count("*").alias("n_peaks"))
    return steps.join(counts, [*keys, "threshold"], "left").na.fill(0, ["n_peaks"])


def annotation_totals(words: DataFrame, flags: list[str]) -> DataFrame:
    """Words, stories, and count and share of each flag."""
    parts = [x for f in flags for x in (F.sum(F.col(f).cast("int")).alias(f"n_{f}"), F.avg(F.col(f).cast("double")).alias(f"share_{f}"))]
    return words.agg(F.count("*").alias("n_words"), F.count_distinct("story").alias("n_stories"), *parts)
