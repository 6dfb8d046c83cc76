"""Byte-level text scanning shared by the corpus operators.

Everything here works on one slice of an Arrow batch inside a task: the texts
of the slice lie end to end in one byte array, and words, lines and n-grams are
index arrays into it.  A slice is cut by bytes, so memory does not follow the
number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
#: Two prime moduli under 2^31, each with a base of its own, and a value for each byte.
_PRIMES = (2147483647, 2147483629)
_BASES = (1540483477, 1103515245)
_BYTES = np.random.default_rng(20240101).integers(1, 2147483629, (2, 256)).astype(np.uint64)
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_MOST_KEPT = 4 << 20


def slices(batch: pa.RecordBatch, text_col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most `limit` text bytes (a longer row stands alone)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and each row's offsets; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    _, raw_offsets, data = col.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime, kept for the next slice unless a very long row asked for it."""
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        size = -(-n // 65536) * 65536
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have[: size - len(have)] * _U(pow(base, len(have), prime)) % _U(prime)])
        if size <= _MOST_KEPT:
            _POWERS[base, prime] = have
    return have[:n]


class SpanHash:
    """Content hash of any byte span of `buf`: residues of one polynomial modulo two primes, 62 bits, from prefix sums.

    A prime modulus leaves no texts that collide whatever the base, as a power
    of two does; for given texts of n bytes a collision has odds of about n^2 in 2^62.
    """

    def __init__(self, buf: np.ndarray):
        self.sums = []
        for prime, base, value in zip(_PRIMES, _BASES, _BYTES):
            prefix = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(value[buf] * powers(base, prime, len(buf)) % _U(prime), out=prefix[1:])  # terms under 2^31: no overflow to 2^33 bytes
            self.sums.append((prefix, powers(pow(base, -1, prime), prime, len(buf) + 1), _U(prime)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = ((prefix[end] - prefix[start]) % prime * inverse[start] % prime for prefix, inverse, prime in self.sums)
        return mix((high << _U(31) | low) + (end - start).astype(np.uint64) * _MUL)

    def all_of(self, size: int) -> np.ndarray:
        """The hash of every span of `size` bytes, by its start."""
        low, high = ((prefix[size:] - prefix[:-size]) % prime * inverse[: len(prefix) - size] % prime for prefix, inverse, prime in self.sums)
        return mix((high << _U(31) | low) + _U(size) * _MUL)


def same_bytes(buf: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans that begin at `one` and at `other` hold the same `size` bytes."""
    if not len(size):
        return np.zeros(0, bool)
    begin = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(begin, size)
    differ = np.concatenate([[0], np.cumsum(buf[np.repeat(one, size) + step] != buf[np.repeat(other, size) + step])])
    return differ[begin + size] == differ[begin]


class Words:
    """Words of a slice: start, end, row and (on request) content hash of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.rows = buf, offsets, len(offsets) - 1
        solid = ~SPACE[buf]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = np.unique(offsets)
        begin, end = edges[edges < len(buf)], edges[edges > 0] - 1
        first[begin] = solid[begin]
        last[end] = solid[end]
        self.solid = solid
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=self.rows)
        self.first_of_row = np.concatenate([[0], np.cumsum(self.per_row)])

    def hash(self, spans: SpanHash | None = None) -> np.ndarray:
        return (spans or SpanHash(self.buf))(self.start, self.end)


def ngrams(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each n-gram that stays in one row, and the n-gram's hash."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    value = np.zeros(m, np.uint64)
    for j in range(n):
        value = value * _MUL + hashes[j : j + m]
    return at, mix(value[at] + _U(n))


def in_row_order(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by (row, key) folded into one key, and which places equal their predecessor."""
    folded = keys ^ mix(rows.astype(np.uint64) + _U(1))
    order = np.argsort(folded, kind="stable")
    ordered = folded[order]
    same = np.zeros(len(order), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    return order, same


def shingles(words: Words, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle; a row of 1 to n-1 words has one shingle of all its words."""
    at, value = ngrams(words, hashes, n)
    row = words.row[at]
    short = np.flatnonzero((words.per_row > 0) & (words.per_row < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        begin, count = words.first_of_row[short], words.per_row[short]
        for j in range(n - 1):
            use = count > j
            extra[use] = extra[use] * _MUL + hashes[begin[use] + j]
        row = np.concatenate([row, short])
        value = np.concatenate([value, mix(extra + count.astype(np.uint64))])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return row, value
