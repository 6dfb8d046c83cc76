"""Removal of repeated byte strings by merged suffix orders.

A byte goes if a string of `length` bytes that covers it also starts earlier
(smaller id, or earlier in the same document).  Windows of that length are told
apart in three steps, all on the input:

1.  Every window has an anchor, the least-hashed short gram inside it, so equal
    windows have equal anchors at equal places.  Consecutive windows with one
    anchor are a segment.  Segments meet by anchor; an anchor that occurs once
    holds no repeat, and of segments with the same bytes (by a hash of 62 bits
    modulo two primes) all but the first are repeats as a whole
    (pre-aggregation: one of them goes on).
2.  Different segments of one anchor may share some windows.  They are cut from
    the texts and dealt into tasks by anchor; a task builds the
    Burrows-Wheeler transforms of several shards of its segments, merges them
    by interleave refinement and reads the repeated intervals (bwt_merge).
3.  An anchor with more than `hot_segments` different segments (the edge of a
    passage that very many documents share) is not put into one task: its
    windows are grouped one by one by two such hashes of their bytes.

Defined cases: null counts as empty; a text shorter than `length` keeps all
bytes; matches never cross documents; rows that repeat an id (or have none, in
front) are separate documents, in order of a hash of their text, so of
repeated rows all but one go; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_merge import repeated_windows
from .shared import written
from .textscan import SpanHash, pack, slices

_U = np.uint64
#: Places are start << 16 | number of windows.
_BITS = 16


def _segments(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, segment hash) of every segment of a slice."""
    n, wide = len(buf), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = SpanHash(buf)
    grams = spans.all_of(gram)
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    count = np.maximum(np.diff(offsets) - (length - 1), 0)
    window = np.repeat(offsets[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(window):
        return _segments(buf[:0], offsets[:1] * 0, length, gram)
    anchor = (low[window] & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    windows = np.diff(np.concatenate([first, [len(window)]]))
    start = window[first]
    return row[first], start - offsets[row[first]], windows, grams[anchor[first]], spans(start, start + windows - 1 + length)


def _chunks(column: pa.Array, length: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before, buffer, offsets): a slice as it is, a single very long row in overlapping chunks."""
    buf, offsets = pack(column)
    if len(buf) <= 2 * limit or len(offsets) > 2:
        yield 0, 0, buf, offsets
        return
    for at in range(0, len(buf), limit):
        part = buf[at : at + limit + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def _anchors(length: int, gram: int):
    """Documents -> (anchor, segment, id, place); rows without an anchor are repeats already, of a segment seen in the same slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_numpy()
                for _, before, buf, offsets in _chunks(part.column("text"), length):
                    row, start, windows, anchor, segment = _segments(buf, offsets, length, gram)
                    own, place = ids[row], ((start + before) << _BITS) | windows
                    order = np.lexsort((place, own, segment, anchor))
                    anchor, segment, own, place = anchor[order].view(np.int64), segment[order].view(np.int64), own[order], place[order]
                    again = np.zeros(len(order), bool)
                    again[1:] = (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, mask=again), pa.array(segment, mask=again), pa.array(own), pa.array(place)], names=["anchor", "segment", "id", "place"])

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, segment, id, place) -> repeats (no anchor) and the first of each segment of an anchor with several.

    What is carried between batches is the first and the last row of the open
    anchor, however many rows it has.
    """
    held: list[tuple[int, int, int, int, bool]] = []  # anchor, segment, id, place, whether it was handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        direct = pc.is_null(batch.column("anchor"))
        done = batch.filter(direct)
        if done.num_rows:
            yield done.drop_columns(["segment"])
        rest = batch.filter(pc.invert(direct))
        if not rest.num_rows:
            continue
        anchor, segment, own, place = (np.concatenate([np.array([h[k] for h in held], np.int64), rest.column(k).to_numpy()]) for k in range(4))
        old = np.zeros(len(anchor), bool)
        old[: len(held)] = True
        handed = np.zeros(len(anchor), bool)
        handed[: len(held)] = [h[4] for h in held]
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_segment = new_anchor.copy()
        new_segment[1:] |= segment[1:] != segment[:-1]
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group, new_segment)[group] > 1
        repeat = ~new_segment & ~old
        contested = new_segment & several & ~handed
        handed |= contested
        first = int(np.flatnonzero(new_anchor)[-1])
        last = len(anchor) - 1
        held = [(int(anchor[i]), int(segment[i]), int(own[i]), int(place[i]), bool(handed[i])) for i in sorted({first, last})]
        if last != first:
            held[-1] = (*held[-1][:4], True)  # its own segment has been dealt with
        out = np.flatnonzero(repeat | contested)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[out], mask=repeat[out]), pa.array(own[out]), pa.array(place[out])], names=["anchor", "id", "place"])


_PIECES = "task long, check long, id long, start long, bytes binary"


def _cut(length: int, tasks: int):
    """Documents with their contested segments -> the segments' bytes by task; of hot anchors each window's hashes instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                task, check, ids, starts, raw = [], [], [], [], []
                for own, text, segments in zip(part.column("id").to_pylist(), part.column("text"), part.column("segments").to_pylist()):
                    data = text.as_py().encode()
                    hot_at = []
                    for s in segments:
                        start, windows = s["place"] >> _BITS, s["place"] & 0xFFFF
                        if s["hot"]:
                            hot_at.append(np.arange(start, start + windows))
                        else:
                            task.append(s["anchor"] % tasks)
                            check.append(None)
                            ids.append(own)
                            starts.append(start)
                            raw.append(data[start : start + windows - 1 + length])
                    if hot_at:
                        at = np.concatenate(hot_at)
                        buf = np.frombuffer(data, np.uint8)
                        a = SpanHash(buf)(at, at + length).view(np.int64)
                        b = SpanHash(255 - buf)(at, at + length).view(np.int64)
                        task += a.tolist()
                        check += b.tolist()
                        ids += [own] * len(at)
                        starts += at.tolist()
                        raw += [None] * len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task, pa.int64()), pa.array(check, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["task", "check", "id", "start", "bytes"]
                )

    return run


def _merge_tasks(length: int):
    """Segments sorted by task -> (id, place) of the runs of windows that also occur earlier."""

    def task(table: pa.Table) -> pa.RecordBatch:
        owners, starts = table.column("id").to_numpy(), table.column("start").to_numpy()
        segment, offset = repeated_windows(table.column("bytes").to_pylist(), owners, starts, length)
        fresh = np.ones(len(segment), bool)
        fresh[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(fresh)
        windows = np.diff(np.concatenate([first, [len(segment)]]))
        place = ((starts[segment[first]] + offset[first]) << _BITS) | windows
        return pa.RecordBatch.from_arrays([pa.array(owners[segment[first]]), pa.array(place)], names=["id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                key = batch.column("task").to_numpy()
                same = int(np.searchsorted(key, key[0], side="right"))
                if held and held[0].column("task")[0].as_py() != key[0]:
                    yield task(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield task(pa.Table.from_batches(held))

    return run


def _finish(length: int):
    """Documents with the places of their repeats -> what is left of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, kept_texts = [], [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                data = (text.as_py() or "").encode()
                gone = 0
                begin = end = np.zeros(0, np.int64)
                if places.is_valid and len(places):
                    place = np.sort(places.values.to_numpy())
                    begin, end = place >> _BITS, (place >> _BITS) + (place & 0xFFFF) - 1 + length
                    reach = np.maximum.accumulate(end)
                    fresh = np.ones(len(begin), bool)
                    fresh[1:] = begin[1:] > reach[:-1]
                    first = np.flatnonzero(fresh)
                    begin, end = begin[first], reach[np.concatenate([first[1:] - 1, [len(reach) - 1]])]
                    gone = int((end - begin).sum())
                cuts = [0, *np.stack([begin, end], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                size.append(len(data))
                removed.append(gone)
                spans.append(len(begin))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_texts, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with distinct ids in document order, and the map back to the input's ids where they had to be numbered."""
    slim = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    if dict(slim.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        slim = slim.withColumn("id", F.col("id").cast("long"))
        rows, known = slim.groupBy("id").count().agg(F.sum("count"), F.count(F.when(F.col("id").isNotNull(), 1))).first()
        if rows is None or rows == known:
            return slim, None
    numbered = written(slim.orderBy(F.col("id").asc_nulls_first(), F.xxhash64("text")).select(F.col("id").alias("given"), "text", F.monotonically_increasing_id().alias("id")))
    return numbered.select("id", "text"), numbered.select("id", "given")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, hot_segments: int = 4096, task_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the bytes left, on request)."""
    if not 0 < gram <= length < 1 << _BITS:
        raise ValueError(f"gram and length must fulfil 0 < gram <= length < {1 << _BITS}")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, given = _ordered(docs, id_col, text_col)

    anchors = texts.mapInArrow(_anchors(length, gram), "anchor long, segment long, id long, place long")
    met = anchors.repartition(partitions, F.coalesce("anchor", "id")).sortWithinPartitions("anchor", "segment", "id", "place")
    found = written(met.mapInArrow(_resolve, "anchor long, id long, place long"))

    contested = found.filter("anchor is not null")
    per_anchor = contested.groupBy("anchor").count()
    hot = per_anchor.filter(F.col("count") > hot_segments).select("anchor", F.lit(True).alias("hot"))
    n_segments, n_hot = contested.count(), hot.count()
    tasks = max(1, -(-n_segments * (length + gram) // task_bytes))
    home = texts.repartition(partitions, "id")  # one shuffle of the texts, used by both joins
    places = F.collect_list(F.struct("anchor", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segments")
    wanted = contested.join(hot, "anchor", "left").groupBy("id").agg(places)
    pieces = home.join(wanted, "id").mapInArrow(_cut(length, tasks), _PIECES)
    repeats = found.filter("anchor is null").select("id", "place")
    cold = pieces.filter("bytes is not null").repartition(partitions, "task").sortWithinPartitions("task")
    repeats = repeats.unionByName(cold.mapInArrow(_merge_tasks(length), "id long, place long"))
    if n_hot:
        windows = pieces.filter("bytes is null").select("task", "check", "id", "start")
        first = windows.groupBy("task", "check").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        later = windows.join(first, ["task", "check"]).filter(F.struct("id", "start") > F.col("first"))
        repeats = repeats.unionByName(later.select("id", F.shiftleft("start", _BITS).bitwiseOR(F.lit(1)).cast("long").alias("place")))

    by_document = repeats.groupBy("id").agg(F.collect_list("place").alias("places"))
    left = home.join(by_document, "id", "left").select("id", "text", "places")
    out = left.mapInArrow(_finish(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if given is not None:
        out = out.join(given, "id").drop("id").withColumnRenamed("given", "id")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else []))
