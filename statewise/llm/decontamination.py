"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles (powers of two).  For
the partition with at most u shingles a document is read as overlapping windows
of 2u shingles with stride u, so an item that occurs anywhere lies inside one
window and shares at least a fifth of its union with it: MinHash values of
window and item then agree in some of the hash functions (48 by default) with
probability over 0.9999 at containment 0.8, however long the document is.
Candidates are verified by exact containment of the item's shingles in the
whole document's.

The index of at most `part_bytes` of item text is built once, in a task, and sent
to the tasks that read documents.  A larger item set is searched part by part:
each pass writes what it found to the shared folder and gives its index up
before the next, so neither the driver nor an executor holds more than one part.

Defined cases: shingles are five words; an item or document of one to four
words has one shingle of all its words; null and empty texts have none and
never match; repeated rows give repeated results; an empty item set matches
nothing; an empty table gives an empty result; other columns, whatever their
names, are not read (`drop_contaminated` hands them on).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textscan import Words, pack, shingles, slices

_U = np.uint64


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


@dataclass
class Partition:
    """Items with more than `most`/2 and at most `most` shingles, and per hash function their minima in order."""

    most: int
    minima: np.ndarray  # functions x items, sorted along items
    items: np.ndarray  # which item each minimum is of


class ItemIndex:
    """MinHash index of the items, partitioned by size."""

    def __init__(self, ids: list, texts: list, hashes: int, threshold: float):
        self.ids, self.threshold = ids, threshold
        self.a, self.b = _functions(hashes)
        words = Words(*pack(pa.array(texts, pa.large_string())))
        row, value = shingles(words, words.hash())
        self.sets = [np.unique(v) for v in np.split(value, np.searchsorted(row, np.arange(1, len(ids))))] if ids else []
        sizes = np.array([len(s) for s in self.sets], np.int64)
        self.partitions = []
        for most in sorted({1 << int(n - 1).bit_length() for n in sizes if n}):
            own = np.flatnonzero((sizes > most // 2) & (sizes <= most))
            mins = np.stack([((self.sets[i] >> _U(32)).astype(np.uint32) * self.a[:, None] + self.b[:, None]).min(1) for i in own], 1)
            order = np.argsort(mins, 1)
            self.partitions.append(Partition(most, np.take_along_axis(mins, order, 1), own[order]))

    def candidates(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Distinct row << 32 | item of windows that agree with an item in a hash function; `row` is in order."""
        if not len(value) or not self.partitions:
            return np.zeros(0, np.int64)
        x = (value >> _U(32)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(row)) + 1
        begin = np.concatenate([[0], edges])
        length = np.diff(np.concatenate([begin, [len(row)]]))
        found, blocks = [], []
        for p in self.partitions:
            per = -(-length // p.most)
            first = np.repeat(begin, per)
            step = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            start = first + step * p.most
            own = row[start]
            blocks.append((start, own, np.flatnonzero(own[:-1] == own[1:])))
        for j in range(len(self.a)):
            h = x * self.a[j] + self.b[j]
            for p, (start, own, pair) in zip(self.partitions, blocks):
                low = np.minimum.reduceat(h, start)
                window = low.copy()
                window[pair] = np.minimum(low[pair], low[pair + 1])
                mins = p.minima[j]
                lo, hi = np.searchsorted(mins, window), np.searchsorted(mins, window, side="right")
                hit = np.flatnonzero(hi > lo)
                while len(hit):
                    found.append(own[hit].astype(np.int64) << 32 | p.items[j][lo[hit]])
                    lo[hit] += 1
                    hit = hit[hi[hit] > lo[hit]]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared, of): verified finds of a slice, at least `threshold` of the item's shingles."""
        words = Words(*pack(column))
        row, value = shingles(words, words.hash())
        pairs = self.candidates(row, value)
        kept: list[tuple[int, int, int, int]] = []
        last, own = -1, np.zeros(0, np.uint64)
        for pair in pairs.tolist():
            r, item = pair >> 32, pair & 0xFFFFFFFF
            if r != last:
                last, own = r, np.unique(value[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")])
            wanted = self.sets[item]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[at] == wanted).sum())
            if shared >= self.threshold * len(wanted) - 1e-9:
                kept.append((r, item, shared, len(wanted)))
        return tuple(np.array(x, np.int64) for x in zip(*kept)) if kept else tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]


_CHUNK = 1 << 20
#: The index that this worker unpacked last, by its broadcast.
_OPEN: dict[int, ItemIndex] = {}


def _opened(packed: Broadcast, name: int) -> ItemIndex:
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = pickle.loads(packed.value)
    return _OPEN[name]


def _packed_index(part: DataFrame, hashes: int, threshold: float) -> bytes:
    """The index of some items, built in one task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
        raw = pickle.dumps(ItemIndex(ids, texts, hashes, threshold))
        pieces = [raw[at : at + _CHUNK] for at in range(0, len(raw), _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["n", "raw"])

    return b"".join(bytes(r["raw"]) for r in sorted(part.coalesce(1).mapInArrow(build, "n int, raw binary").collect(), key=lambda r: r["n"]))


def _indexes(items: DataFrame, item_id: str, item_text: str, part_bytes: int, hashes: int, threshold: float) -> Iterator[tuple[Broadcast, bool]]:
    """(index, whether it is the last) of each part of the items."""
    slim = items.select(items[item_id].alias("id"), F.coalesce(items[item_text], F.lit("")).alias("text"))
    total = slim.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    for k in range(parts):
        part = slim.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        yield items.sparkSession.sparkContext.broadcast(_packed_index(part, hashes, threshold)), k == parts - 1


def find_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, hashes: int = 48, part_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document and item that it contains: ids, n_shared, n_item, containment."""
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_kind, item_field = slim.schema["id"].dataType.simpleString(), items.select(items[item_id].alias("item"))
    item_kind, arrow_kind = item_field.schema["item"].dataType.simpleString(), item_field.limit(0).toArrow().schema.field("item").type
    found = []
    for shared, last in _indexes(items, item_id, item_text, part_bytes, hashes, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=shared._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            index = _opened(shared, name)
            for batch in batches:
                for part in slices(batch, "text"):
                    row, item, n_shared, n_item = index.search(part.column("text"))
                    item_ids = pa.array([index.ids[i] for i in item.tolist()], arrow_kind)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), item_ids, pa.array(n_shared), pa.array(n_item)], names=["id", "item", "n_shared", "n_item"])

        of_part = slim.mapInArrow(run, f"id {id_kind}, item {item_kind}, n_shared long, n_item long")
        if not last:
            of_part = written(of_part)
            shared.destroy()
        found.append(of_part)
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, hashes: int = 48, part_bytes: int = 32 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns unchanged, that contain no item."""
    out = docs
    for shared, last in _indexes(items, item_id, item_text, part_bytes, hashes, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=shared._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            index = _opened(shared, name)
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[index.search(part.column(text_col))[0]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
        if not last:
            out = written(out)
            shared.destroy()
    return out
