"""First digits of MD5 of many short texts with one beginning each and many endings, on arrays of 32-bit words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACE = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: Steps after which the digest's first word is known.
_STEPS = 61


def laid(texts: list[bytes], at: int) -> np.ndarray:
    """(16, texts): the words of a block that holds each text from byte `at` on and nothing else."""
    block = np.frombuffer(b"".join((bytes(at) + t).ljust(64, b"\0") for t in texts), "<u4")
    return np.ascontiguousarray(block.reshape(len(texts), 16).T)


_TURN = {n: np.array(n, np.uint32) for row in _TURNS for turn in row for n in (turn, 32 - turn)}


def _steps(state: list[np.ndarray], spare: list[np.ndarray], steps: range, keyed: dict[int, np.ndarray], fixed: np.ndarray) -> list[np.ndarray]:
    """MD5's steps in place; `keyed` holds for a step the block's word, as far as it differs between texts, plus the step's constant, `fixed` the rest of the words."""
    (a, b, c, d), (t, u, e) = state, spare
    for i in steps:
        kind, word = i // 16, _PLACE[i // 16](i)
        if kind == 0:
            np.bitwise_xor(c, d, t)
            np.bitwise_and(t, b, t)
            np.bitwise_xor(t, d, t)
        elif kind == 1:
            np.bitwise_xor(b, c, t)
            np.bitwise_and(t, d, t)
            np.bitwise_xor(t, c, t)
        elif kind == 2 and i % 2 and i > steps.start:
            np.bitwise_xor(e, b, t)  # c and d are the b and c of the step before
        elif kind == 2:
            np.bitwise_xor(b, c, e)
            np.bitwise_xor(e, d, t)
        else:
            np.invert(d, t)
            np.bitwise_or(t, b, t)
            np.bitwise_xor(t, c, t)
        np.add(t, a, t)
        rest = int(fixed[word])
        if i in keyed:
            np.add(t, keyed[i], t)
        else:
            rest += _SINES[i]
        if rest:
            np.add(t, np.array(rest % 2**32, np.uint32), t)
        turn = _TURNS[kind][i % 4]
        np.left_shift(t, _TURN[turn], u)
        np.right_shift(t, _TURN[32 - turn], t)
        np.bitwise_or(t, u, t)
        np.add(t, b, a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def leads(head: list[np.ndarray], size: int, tails: Iterable[bytes]) -> Iterator[np.ndarray]:
    """For each tail, the numbers that the first eight hex digits of md5(text + tail) are, for texts of `size` bytes whose words are `head`.

    Steps that no tail reaches are taken once.  Texts and tails have 55 bytes together at most, one block.
    """
    n = len(head[0])
    state, now, spare = ([np.empty(n, np.uint32) for _ in range(k)] for k in (4, 4, 3))
    keyed = {i: head[word] + np.uint32(_SINES[i]) for i in range(_STEPS) if (word := _PLACE[i // 16](i)) < len(head)}
    for s, v in zip(state, _START):
        s.fill(v)
    state = _steps(state, spare, range(size // 4), keyed, np.zeros(16, "<u4"))
    for tail in tails:
        if size + len(tail) > 55:
            raise ValueError(f"{size + len(tail)} bytes are more than a block")
        fixed = np.frombuffer((bytes(size) + tail + b"\x80").ljust(56, b"\0") + (8 * (size + len(tail))).to_bytes(8, "little"), "<u4")
        for s, v in zip(now, state):
            np.copyto(s, v)
        last = _steps(list(now), spare, range(size // 4, _STEPS), keyed, fixed)[1]
        last += np.uint32(_START[0])
        yield last.byteswap()
