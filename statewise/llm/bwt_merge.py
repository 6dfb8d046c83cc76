"""Burrows-Wheeler transforms of shards and their merge by interleave refinement.

Each shard is a cyclic text of segments with a terminator after each.  A
shard's rotations are sorted once, to a fixed depth.  Shards are merged without
sorting suffixes again: the interleave (which shard the next rotation in merged
order comes from) is correct to depth 0 at the start; one stable distribution
of it by the transforms' symbols makes it correct one step deeper, a step being
the symbols of the bytes before a rotation.  Intervals of rotations that agree to the
current depth split in place, so the depth of a split is the common prefix of
its two neighbours, and the intervals left at the last depth are the repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Never a byte of UTF-8 text.
TERMINATOR = 0xFF
STEP = 8


@dataclass
class Transform:
    """Rotation order of a shard and, in that order, the STEP bytes before each rotation as one symbol."""

    order: np.ndarray
    symbols: np.ndarray


def transform(text: np.ndarray, depth: int) -> Transform:
    """Sort the rotations of a cyclic text by at least `depth` bytes (prefix doubling)."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.uint64)
        change = np.zeros(n, bool)
        change[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(change).astype(np.uint64)
        if known >= depth:
            break
        key = (rank << np.uint64(32)) | np.roll(rank, -known % n)
        known *= 2
    before = np.zeros(n, np.uint64)
    for j in range(STEP, 0, -1):
        before = (before << np.uint64(8)) | np.roll(text, j)
    return Transform(order, before[order])


def merge(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged order of all shards' rotations to `depth` bytes: (shard, place in the shard's order, interval, common prefix with the predecessor).

    The first step takes the bytes that are left over when `depth` is cut into
    steps.  The common prefix is exact to a step and stands at `depth` where,
    and only where, the neighbours agree that far.
    """
    sizes = np.array([len(p.order) for p in parts])
    before = np.concatenate([p.symbols for p in parts])
    whole = _dense(before)
    base = np.concatenate([[0], np.cumsum(sizes)])
    shard = np.repeat(np.arange(len(parts), dtype=np.uint8 if len(parts) < 256 else np.uint32), sizes)
    interval = np.zeros(len(shard), np.int32)
    common = np.full(len(shard), -1, np.int32)
    rest = depth % STEP
    for known in [*([0] if rest else []), *range(rest, depth, STEP)]:
        symbols = _dense(before & np.uint64((1 << 8 * rest) - 1)) if rest and not known else whole
        symbol = symbols[_places(shard, base)]
        moved = _distribution(symbol)
        symbol, came_from = symbol[moved], interval[moved]
        split = np.zeros(len(shard), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) | (came_from[1:] != came_from[:-1])
        refined = shard[moved]
        common[split & (common < 0)] = known
        fresh = np.cumsum(split, dtype=np.int32)
        if known and fresh[-1] == interval[-1] and np.array_equal(refined, shard) and np.array_equal(fresh, interval):
            break
        shard, interval = refined, fresh
    common[common < 0] = depth
    if len(common):
        common[0] = 0
    place = _places(shard, base)
    return shard, place - base[shard], interval, common


def _dense(symbols: np.ndarray) -> np.ndarray:
    """Symbols numbered in order, in 16 bits where they fit, so that a distribution is one radix pass."""
    alphabet, code = np.unique(symbols, return_inverse=True)
    return code.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)


def _distribution(symbol: np.ndarray) -> np.ndarray:
    """Stable distribution by symbol, 16 bits a pass: no comparison of suffixes."""
    if symbol.dtype == np.uint16:
        return np.argsort(symbol, kind="stable")
    low = np.argsort(symbol.astype(np.uint16), kind="stable")
    return low[np.argsort((symbol >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def _places(shard: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Place in the concatenated transforms: a shard's rotations come in its own order."""
    place = np.empty(len(shard), np.int32)
    place[np.argsort(shard, kind="stable")] = np.arange(len(shard), dtype=np.int32)
    return place


def repeated_windows(segments: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `length` bytes of the segments that also occur earlier: (segment, offset), ordered.

    A window's place is (owners[segment], starts[segment] + offset); of equal
    windows the least place is the one that is not returned.
    """
    per = -(-len(segments) // shards)
    parts, of_segment, of_offset = [], [], []
    for at in range(0, len(segments), per):
        own = segments[at : at + per]
        size = np.array([len(s) + 1 for s in own])
        text = np.frombuffer(b"".join(s + bytes([TERMINATOR]) for s in own), np.uint8)
        which = np.repeat(np.arange(len(own)), size)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        part = transform(text, length + STEP)
        parts.append(part)
        of_segment.append((which + at)[part.order])
        of_offset.append(offset[part.order])
    shard, place, _, common = merge(parts, length)
    interval = np.cumsum(common < length)  # rotations that agree with their predecessor for a whole window are repeats of it
    base = np.concatenate([[0], np.cumsum([len(p.order) for p in parts])])
    flat = base[shard] + place
    segment, offset = np.concatenate(of_segment)[flat], np.concatenate(of_offset)[flat]
    whole = np.array([len(s) for s in segments])[segment] - offset >= length
    segment, offset, interval = segment[whole], offset[whole], interval[whole]
    order = np.lexsort((starts[segment] + offset, owners[segment], interval))
    segment, offset, interval = segment[order], offset[order], interval[order]
    again = np.zeros(len(order), bool)
    again[1:] = interval[1:] == interval[:-1]
    segment, offset = segment[again], offset[again]
    order = np.lexsort((offset, segment))
    return segment[order], offset[order]
