"""SimHash near-duplicates by one-wildcard segment variants.

A fingerprint has a bit set where over half of a text's shingle hashes have it.
Rows of one fingerprint are one node, so copies are never compared.  Links are
pairs of nodes that differ in at most two bits.  The 64 bits are cut into two
segments only: of two differing bits at most one lies in one of them.  Each node
is indexed under its segments' variants:

* the high segment with one bit as a wildcard, 32 variants: partners differ in
  just that bit, and in one bit of the low segment;
* either segment as it is: partners differ in one or two bits of the other.

Every linked pair stands under exactly one of these keys in this way, found by
an equality join on the key and verified on the whole fingerprint.  A key's
nodes are compared inside one task; what leaves it is a row for each node, tied
to the least node that the key's links reach.  A key with more than `bucket`
nodes is split instead by the variants of its other segment (two wildcards where
the key's segment is whole, one where it has a wildcard), under each of which at
most four nodes can stand: the same links, with work linear in the key's nodes.

Defined cases: a text of one or two words has one shingle of all its words; a
text without words (null, empty) has fingerprint zero and is linked like any
other; ids may be repeated, null or of any type with an order, a component's name is its least
id (null where no row has one); a text of any length is read in one task, its
votes added up in blocks; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import connected_components
from .shared import over_cores, written
from .textscan import Words, pack, slices

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW = _U(0xFFFFFFFF)
#: Keys of a segment as it is carry these in place of a wildcard's bit.
HIGH_WHOLE, LOW_WHOLE = 64, 65


def shingle_hashes(column: pa.Array, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, XXH64) of every n-word shingle of a slice, words lower-cased and joined by a space; and the number of rows."""
    words = Words(*pack(column))
    size = words.end - words.start
    start = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(start[-1], 32, np.uint8)
    solid = np.flatnonzero(words.solid)
    joined[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = _LOWER[words.buf[solid]]
    text = joined.tobytes()
    row = words.row
    first = words.first_of_row[:-1]
    last = np.minimum(np.arange(len(row)) + n, words.first_of_row[1:][row]) - 1  # of the shingle that begins at each word
    begins = (np.arange(len(row)) + n <= words.first_of_row[1:][row]) | (np.arange(len(row)) == first[row]) & (words.per_row[row] < n)
    at = np.flatnonzero(begins)
    ends = start[last[at]] + size[last[at]]
    hashes = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in zip(start[at].tolist(), ends.tolist())), np.uint64, len(at))
    return row[at], hashes, words.rows


def fingerprints_of(row: np.ndarray, hashes: np.ndarray, rows: int, block: int = 1 << 16) -> np.ndarray:
    """The 64-bit fingerprint of each row; rows without hashes have zero."""
    votes, total = np.zeros((rows, 64), np.int64), np.bincount(row, minlength=rows)
    for at in range(0, len(row), block):
        here, some = row[at : at + block], hashes[at : at + block]
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        votes[here[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): the fingerprint of every row, its 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bits = fingerprints_of(*shingle_hashes(part.column("text"), n, seed))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bits.view(np.int64))], names=["id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return over_cores(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"id {kind}, bits long")


def _linked(kind: int, bits: np.ndarray, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the link matrix among one key's nodes: (first row, boolean rows x nodes)."""
    low, high = bits & _LOW, bits >> _U(32)
    for at in range(0, len(bits), block):
        if kind < HIGH_WHOLE:
            across = ((high[at : at + block, None] ^ high[None, :]) >> _U(kind - 32)) & _U(1) == 1
            yield at, across & (np.bitwise_count(low[at : at + block, None] ^ low[None, :]) == 1)
        else:
            other = low if kind == HIGH_WHOLE else high
            yield at, np.bitwise_count(other[at : at + block, None] ^ other[None, :]) <= 2


def _ties(kind: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that the key's links reach) of a key's nodes that have links."""
    signed = bits.view(np.int64)
    least, blocks = signed.copy(), list(_linked(kind, bits))
    while True:
        before = least.copy()
        for at, link in blocks:
            least[at : at + len(link)] = np.minimum(least[at : at + len(link)], np.where(link, least[None, :], np.iinfo(np.int64).max).min(1))
        if (least == before).all():
            break
    moved = least != signed
    return signed[moved], least[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, bits) sorted by key -> (u, v) ties of each key's nodes; a key never has more than `bucket` nodes."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        kind, key, bits = (table.column(c).to_numpy() for c in ("kind", "key", "bits"))
        cut = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
        begin = np.concatenate([[0], cut])
        held = table.slice(begin[-1])
        yield _all_ties(kind, bits.view(np.uint64), begin)
    if held is not None:
        yield _all_ties(held.column("kind").to_numpy(), held.column("bits").to_numpy().view(np.uint64), np.array([0, held.num_rows]))


def _all_ties(kind: np.ndarray, bits: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    size = np.diff(begin)
    u, v = [], []
    pair = begin[:-1][size == 2]  # most keys: at once
    a, b = bits[pair], bits[pair + 1]
    differ, which = a ^ b, kind[pair]
    at_most = np.bitwise_count(differ & _LOW) == 1
    across = (which < HIGH_WHOLE) & ((differ >> _U(32)) != 0) & at_most
    whole = (which >= HIGH_WHOLE) & (np.bitwise_count(differ) <= 2)
    keep = across | whole
    u.append(a[keep].view(np.int64))
    v.append(b[keep].view(np.int64))
    for k in np.flatnonzero(size > 2):
        x, y = _ties(int(kind[begin[k]]), bits[begin[k] : begin[k + 1]])
        u.append(x)
        v.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _keys(nodes: DataFrame) -> DataFrame:
    """(bits) -> (kind, key, bits) of every node's variants."""
    high = F.shiftrightunsigned("bits", 32)
    low = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))
    wild = [F.struct(F.lit(32 + i).alias("kind"), high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).alias("key")) for i in range(32)]
    whole = [F.struct(F.lit(HIGH_WHOLE).alias("kind"), high.alias("key")), F.struct(F.lit(LOW_WHOLE).alias("kind"), low.alias("key"))]
    return nodes.select("bits", F.explode(F.array(*wild, *whole)).alias("k")).select("k.kind", "k.key", "bits")


def _split(kind: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wildcards (one, or pairs) of the other segment of nodes under a key that is too large, and the rest of the segment under each."""
    other = bits >> _U(32) if kind == LOW_WHOLE else bits & _LOW
    ones = np.array([1 << i for i in range(32)], np.uint64)
    masks = ones if kind < HIGH_WHOLE else np.array([a | b for i, a in enumerate(ones) for b in ones[:i]], np.uint64)
    return masks, other[:, None] & ~masks[None, :]


def _split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, bits) of large keys -> (kind, key, mask, rest, bits)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            kind, key, bits = (part.column(c).to_numpy() for c in ("kind", "key", "bits"))
            for k in np.unique(kind):
                mine = np.flatnonzero(kind == k)
                masks, rest = _split(int(k), bits[mine].view(np.uint64))
                row = np.repeat(mine, len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(kind[row]), pa.array(key[row]), pa.array(np.tile(masks, len(mine)).view(np.int64)), pa.array(rest.ravel().view(np.int64)), pa.array(bits[row])], names=["kind", "key", "mask", "rest", "bits"])


def links(nodes: DataFrame, bucket: int = 1024) -> DataFrame:
    """(u, v): ties among distinct fingerprints (bits) whose closure is that of all pairs that differ in at most two bits."""
    keys = _keys(nodes)
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n"))
    sizes = written(sizes.filter("n > 1"))
    wanted = keys.join(sizes.hint("merge"), ["kind", "key"])
    sort = ["kind", "key"]
    small = wanted.filter(F.col("n") <= bucket).select("kind", "key", "bits").repartition(*sort).sortWithinPartitions(*sort).mapInArrow(_compare, "u long, v long")
    large = wanted.filter(F.col("n") > bucket).select("kind", "key", "bits").mapInArrow(_split_keys, "kind int, key long, mask long, rest long, bits long")
    # at most four nodes stand under a split key
    few = large.groupBy("kind", "key", "mask", "rest").agg(F.collect_list("bits").alias("few")).filter(F.size("few") > 1)
    pairs = few.select(F.explode("few").alias("u"), "few").select("u", F.explode("few").alias("v")).filter("u > v")
    right = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    return small.unionByName(pairs.filter(right).select("u", "v"))


def simhash_components(docs: DataFrame, n: int = 3, seed: int = 42, bucket: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id that links reach)."""
    table = written(fingerprints(docs, n, seed, id_col, text_col))
    nodes = written(table.groupBy("bits").agg(F.min("id").alias("first")))
    groups = connected_components(links(nodes.select("bits"), bucket)).select(F.col("id").alias("bits"), "component")
    named = nodes.join(groups, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = written(named.join(firsts, "component").select("bits", "component_id"))
    out = table.join(known.hint("merge"), "bits")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
