"""N-gram Jaccard join: MinHash banding, verified on full shingle sets.

Rows of equal shingle sets are one class, whose row of the smallest id
represents it; only representatives are compared, under a number of their own.
`bands_for` chooses bands and rows per band for a target recall at the
threshold; representatives meet on band hashes.  Links within a band's bucket
are never listed: each member is tied to the bucket's least, so the buckets'
overlaps form candidate components, and every pair that shares a bucket lies
inside one.  A component's texts come together once and all its pairs are
verified on their full sets (shingles as hashes of their words' bytes, which are
taken modulo two primes) by products of incidence blocks, dealt into
(block, block) tasks of bounded size.  A component of more blocks than there are
bands is a chain of buckets rather than a group: there only pairs that share a
bucket are compared, bucket by bucket, each in the first bucket that it shares,
so a text is sent to no more units than there are bands.  What leaves a task is
one row per text: its number of links and its component among the verified
links, so nothing grows with the square of a group.

Defined cases: a text of one to four words has one shingle of all its words; a
text without words (null, empty) has no shingles, is in no class with another
and has no links; ids may be of any type with an order and come back as they
are; rows with a null id are compared like any other, and the ids of a class
that holds no other rows are null; rows of one id and different texts are
different rows; repeated rows are copies; an empty table gives an empty result;
other columns, whatever their names, are not read (`drop_near_copies` hands them
on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_names, written
from .textscan import Words, mix, pack, shingles, slices

_U = np.uint64


def bands_for(threshold: float, recall: float = 0.997, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hash functions with the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding of that many functions has the recall")
    return best


def _sketch(column: pa.Array, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, set key of two values, band hashes) of each row of a slice."""
    words = Words(*pack(column))
    row, value = shingles(words, words.hash(), n)
    size = words.rows
    # distinct within the row
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[first], value[first]
    count = np.bincount(row, minlength=size)
    key, band_hash = np.zeros((size, 2), np.int64), np.zeros((size, bands), np.int64)
    if not len(row):
        return count, key, band_hash
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    have = row[start]
    key[have, 0] = np.add.reduceat(mix(value), start).view(np.int64)
    key[have, 1] = np.add.reduceat(mix(value ^ _U(0xA5A5A5A5A5A5A5A5)), start).view(np.int64)
    rng = np.random.default_rng(11)
    a, b = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (value >> _U(32)).astype(np.uint32)
    work = np.empty_like(x)
    for i in range(bands):
        mixed = np.full(len(start), i + 1, np.uint64)
        for j in range(rows):
            np.multiply(x, a[i * rows + j], out=work)
            np.add(work, b[i * rows + j], out=work)
            mixed = mixed * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, start)
        band_hash[have, i] = mix(mixed).view(np.int64)
    return count, key, band_hash


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, code): an id may stand at several texts, whose hashes tell its rows apart."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("code"))


def sketches(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, code, n_shingles, k0, k1, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count, key, band_hash = _sketch(part.column("text"), n, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * bands), pa.array(band_hash.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("code"), pa.array(count), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), lists], names=["id", "code", "n_shingles", "k0", "k1", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _slim(docs, id_col, text_col).mapInArrow(run, f"id {kind}, code long, n_shingles long, k0 long, k1 long, bands array<long>")


def _links(left: list, right: list, num: int, den: int, shared_columns: int = 4096) -> np.ndarray:
    """Boolean matrix: Jaccard of the sets `left[i]` and `right[j]` is at least num/den (|A and B| * (num + den) >= num * (|A| + |B|))."""
    sizes_l, sizes_r = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    everything, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at_l, at_r = code[: sizes_l.sum()], code[sizes_l.sum() :]
    both = (np.bincount(at_l, minlength=len(everything)) > 0) & (np.bincount(at_r, minlength=len(everything)) > 0)
    column = np.cumsum(both) - 1
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    keep_l, keep_r = both[at_l], both[at_r]
    row_l, col_l, row_r, col_r = row_l[keep_l], column[at_l[keep_l]], row_r[keep_r], column[at_r[keep_r]]
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    row_l, col_l, row_r, col_r = row_l[order_l], col_l[order_l], row_r[order_r], col_r[order_r]
    total = np.zeros((len(left), len(right)), np.float32)  # counts under 2**24 are exact
    for at in range(0, int(both.sum()), shared_columns):
        sl = slice(*np.searchsorted(col_l, [at, at + shared_columns]))
        sr = slice(*np.searchsorted(col_r, [at, at + shared_columns]))
        width = min(shared_columns, int(both.sum()) - at)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a[row_l[sl], col_l[sl] - at] = 1
        b[row_r[sr], col_r[sr] - at] = 1
        total += a @ b.T
    return total.astype(np.int64) * (num + den) >= num * (sizes_l[:, None] + sizes_r[None, :])


_TASK = ["unit", "band", "lo", "hi"]


def _verify(n: int, num: int, den: int):
    """Rows sorted by task -> (id, least, links) of each row of each task.

    A task holds one block (lo = hi) or two of a unit.  A unit with a band is a
    bucket of it, where pairs that share a bucket of an earlier band don't count.
    """

    def task(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, band: int, lo: int, hi: int, texts: pa.Array, signs: np.ndarray) -> pa.RecordBatch:
        words = Words(*pack(texts))
        row, value = shingles(words, words.hash(), n)
        cut = np.searchsorted(row, np.arange(1, len(ids)))
        sets = [np.unique(v) for v in np.split(value, cut)]
        i, j = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links, least = np.zeros(len(ids), np.int64), ids.copy()
        if len(i) and len(j):  # a block may have no member
            linked = _links([sets[k] for k in i], [sets[k] for k in j], num, den)
            for b in range(band):
                linked &= signs[i, b][:, None] != signs[j, b][None, :]
            if lo == hi:
                np.fill_diagonal(linked, False)
            links[i] += linked @ copies[j]
            if lo != hi:
                links[j] += linked.T @ copies[i]
            # least id among those that the links reach, by repeated minima over neighbours
            while True:
                before = least.copy()
                least[i] = np.minimum(least[i], np.where(linked, least[j][None, :], least[i][:, None]).min(1))
                least[j] = np.minimum(least[j], np.where(linked, least[i][:, None], least[j][None, :]).min(0))
                if (least == before).all():
                    break
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least), pa.array(links)], names=["id", "least", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            col = lambda name: table.column(name).to_numpy()
            band = int(col("band")[0])
            signs = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) if band >= 0 else np.zeros((0, 0))
            return task(col("id").copy(), col("copies"), col("block"), band, int(col("lo")[0]), int(col("hi")[0]), table.column("text").combine_chunks(), signs)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            keys = [table.column(c).to_numpy() for c in _TASK]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            begin = np.concatenate([[0], cuts]).astype(int)
            for s, e in zip(begin[:-1], begin[1:]):
                yield emit(table.slice(s, e - s))
            held = table.slice(begin[-1]) if table.num_rows else held
        if held is not None and held.num_rows:
            yield emit(held)

    return run


def _units(wanted: DataFrame, signs: DataFrame, bands: int, block_rows: int, block_bytes: int) -> DataFrame:
    """(node, component, n_shingles) of the candidates, (node, bands) -> (node, homes, bands): the units that compare it, each with band, block and blocks, and its band hashes where they are needed."""

    def blocks(of: DataFrame, *key: str) -> DataFrame:
        sizes = of.groupBy(*key).agg(F.count("*").alias("members"), F.sum("n_shingles").alias("words"))
        n = F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("words") * 6 / block_bytes), F.lit(1)).cast("int")
        return sizes.filter("members > 1").select(*key, n.alias("blocks"))

    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    known = wanted.join(blocks(wanted, "component"), "component")
    home = lambda unit, band: F.struct(unit.alias("unit"), band.cast("int").alias("band"), block, F.col("blocks"))
    groups = known.filter(F.col("blocks") <= bands).select("node", F.array(home(F.col("component"), F.lit(-1))).alias("homes"))
    signed = known.filter(F.col("blocks") > bands).select("node", "n_shingles").join(signs, "node")
    chained = signed.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    in_bucket = chained.join(blocks(chained, "band", "bucket"), ["band", "bucket"])
    homes = in_bucket.groupBy("node").agg(F.collect_list(home(F.col("bucket"), F.col("band"))).alias("homes"))
    return groups.unionByName(homes.join(signs, "node"), allowMissingColumns=True)


def _classes(
    docs: DataFrame, threshold: tuple[int, int] = (4, 5), n: int = 5, recall: float = 0.997, block_bytes: int = 4 << 20, block_rows: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and a row for each shingle set: k0, k1, n_shingles, lead (its row of the least id), copies, links, first (the lead of the least id that links reach)."""
    num, den = threshold
    bands, rows = bands_for(num / den, recall)
    table = written(sketches(docs, n, bands, rows, id_col, text_col))
    lead = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "code")).alias("lead")
    classes = table.filter("n_shingles > 0").groupBy("k0", "k1", "n_shingles").agg(F.count("*").alias("copies"), F.any_value("bands").alias("bands"), lead)
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    hashes = classes.select("node", F.explode("bands").alias("band"))
    least = hashes.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("members")).filter("members > 1")
    ties = hashes.join(least, "band").select(F.col("node").alias("u"), F.col("least").alias("v"))
    candidates = connected_components(ties).withColumnRenamed("id", "node")

    # texts of the candidates, one row for each representative, dealt into bounded tasks
    wanted = candidates.join(classes.select("node", F.col("lead.id").alias("of"), F.col("lead.code").alias("code"), "copies", "n_shingles"), "node")
    wanted = wanted.join(_units(wanted, classes.select("node", "bands"), bands, block_rows, block_bytes), "node")
    texts = _slim(docs, id_col, text_col).withColumnRenamed("code", "own")
    lone = texts.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("code"))).dropDuplicates(["node"])  # a row may be repeated
    homes = lone.select("node", "copies", "text", "bands", F.explode("homes").alias("h")).select("node", "copies", "text", "bands", "h.*")
    dealt = homes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, last = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    dealt = dealt.select("unit", "band", first, last, F.col("node").alias("id"), "copies", "block", "bands", "text")
    verified = dealt.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(_verify(n, num, den), "id long, least long, links long")
    verified = written(verified)
    links = verified.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    groups = connected_components(verified.select(F.col("id").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "node")
    firsts = groups.join(classes.select("node", "lead"), "node").groupBy("component").agg(F.min("lead").alias("first"))

    named = classes.join(links, "node", "left").join(groups.join(firsts, "component").select("node", "first"), "node", "left")
    return table, named.select("k0", "k1", "n_shingles", "lead", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "lead").alias("first"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, class_id, rep_id, n_copies, n_links, n_shingles.

    `rep_id` is the least id with the same shingle set (`n_copies` rows have
    it), `n_links` counts the other rows whose Jaccard similarity with this one
    is at least num/den, copies included, and `class_id` is the least id that
    links reach.
    """
    table, named = _classes(docs, id_col=id_col, **options)
    out = table.select("id", "n_shingles", "k0", "k1").join(named, ["k0", "k1", "n_shingles"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("first.id", "id").alias("class_id"),
        F.coalesce("lead.id", "id").alias("rep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        "n_shingles",
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns unchanged, one of each class: that with the least id, one without an id only where no row has one.

    Of texts without shingles, which are in no class, rows without an id stay as
    they are and repeated rows with an id stay once.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    own, code, held = free_names(docs, "id", "code", "held")
    table, named = _classes(docs, **options)
    bare = table.filter("n_shingles = 0").select("id", "code").distinct()
    keep = named.select("first.id", "first.code").distinct().withColumn("held", F.lit(True)).unionByName(bare.withColumn("held", F.col("id").isNotNull()))
    keep = keep.select(F.col("id").alias(own), F.col("code").alias(code), F.col("held").alias(held))
    out = docs.join(keep, docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(code))).drop(own, code)
    return out.filter(held).drop(held).dropDuplicates([id_col, text_col]).unionByName(out.filter(~F.col(held)).drop(held))
