"""Secret scan through a segmented trigram inverted index.

Each rule's regular expression is reduced to a Boolean trigram query (an AND of
the trigrams of every literal it must contain, an OR over its alternatives).
Each slice of an Arrow batch is one index segment: the positions of the query
trigrams become sorted posting lists of rows, the lists of a literal are
intersected, alternatives are united, and only the rows left are verified with
the expression itself.  A rule without a mandatory trigram scans every row.
Segments are built where the text is read, so no text or posting is shuffled.

Defined cases: null counts as empty and has no span; overlapping finds of
different kinds are all reported; repeated rows give repeated results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C  # the parsed form of an expression, as re itself uses it
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import pack, slices


@dataclass(frozen=True)
class Rule:
    """`group` (0: whole match) must have at least `min_chars` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base kinds, in the order in which ties of a start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds; they only add spans.
EXTRA_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = tuple  # ("all",) | ("lit", text) | ("and", [..]) | ("or", [..])


def _strings(node: list, limit: int = 64) -> list[str] | None:
    """The finite set of strings that a parsed sequence stands for, if it is one."""
    out = [""]
    for op, arg in node:
        if op is C.LITERAL:
            step = [chr(arg)]
        elif op is C.IN and len(arg) <= 8 and all(kind is C.LITERAL for kind, _ in arg):
            step = [chr(value) for _, value in arg]
        elif op is C.SUBPATTERN:
            step = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            step = None if any(p is None for p in parts) else [s for p in parts for s in p]
        elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
            one = _strings(arg[2])
            step = None if one is None else [a for n in range(arg[0], arg[1] + 1) for a in ([""] if n == 0 else one if n == 1 else [x + y for x in one for y in one])]
        else:
            step = None
        if step is None or len(out) * len(step) > limit:
            return None
        out = [a + b for a in out for b in step]
    return out


def trigram_query(pattern: str) -> Query:
    """Boolean query that every text with a match satisfies; ("all",) where nothing is mandatory."""

    def literal(text: str) -> Query:
        return ("lit", text.lower()) if len(text) >= 3 and text.isascii() else ("all",)

    def of(node: list) -> Query:
        terms: list[Query] = []
        run: list = []

        def close() -> None:
            if run:
                options = _strings(run) or [""]
                terms.append(either([literal(s) for s in options]))
                run.clear()

        for item in node:
            op, arg = item
            if _strings([item]) is not None and _strings([*run, item]) is not None:
                run.append(item)
                continue
            close()
            if op is C.SUBPATTERN:
                terms.append(of(arg[3]))
            elif op is C.BRANCH:
                terms.append(either([of(x) for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                terms.append(of(arg[2]))
            elif _strings([item]) is not None:
                run.append(item)
        close()
        terms = [t for t in terms if t != ("all",)]
        return ("all",) if not terms else terms[0] if len(terms) == 1 else ("and", terms)

    def either(parts: list[Query]) -> Query:
        if ("all",) in parts:
            return ("all",)
        return parts[0] if len(parts) == 1 else ("or", parts)

    return of(_parser.parse(pattern))


def _literals(query: Query) -> list[str]:
    if query[0] == "lit":
        return [query[1]]
    return [t for part in query[1] for t in _literals(part)] if query[0] in ("and", "or") else []


def _trigrams(text: str) -> list[int]:
    raw = text.encode()
    return sorted({raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)})


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def marked(wanted: np.ndarray) -> np.ndarray:
    """A flag for every trigram: whether a query needs it."""
    table = np.zeros(1 << 24, bool)
    table[wanted] = True
    return table


class Segment:
    """Posting lists (sorted row numbers) of the wanted trigrams over one slice."""

    def __init__(self, column: pa.Array, wanted: np.ndarray, table: np.ndarray):
        buf, offsets = pack(column)
        self.rows = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {int(t): np.zeros(0, np.int64) for t in wanted}
        if len(buf) < 3 or not len(wanted):
            return
        low = _LOWER[buf].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(table[code])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pair = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        for t, rows in zip(*_split(pair)):
            self.postings[t] = rows

    def find(self, query: Query) -> np.ndarray:
        if query[0] == "all":
            return np.arange(self.rows)
        if query[0] == "lit":
            lists = sorted((self.postings[t] for t in _trigrams(query[1])), key=len)
            out = lists[0]
            for other in lists[1:]:
                out = np.intersect1d(out, other, assume_unique=True)
            return out
        parts = [self.find(p) for p in query[1]]
        out = parts[0]
        for other in parts[1:]:
            out = np.intersect1d(out, other) if query[0] == "and" else np.union1d(out, other)
        return out


def _split(pair: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    key = pair >> 32
    cut = np.flatnonzero(np.diff(key)) + 1
    groups = np.split(pair & 0xFFFFFFFF, cut)
    return [int(k) for k in key[np.concatenate([[0], cut])]] if len(pair) else [], groups if len(pair) else []


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, base: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, `n_<kind>` of each base kind, `base_sha256` and `spans`.

    `spans` lists kind:start:end (code points, end exclusive) of all rules by
    start, then rule order; `base_sha256` digests the same list of the base kinds.
    """
    base_kinds = [r.kind for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, r, r.compiled(), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        wanted = np.array(sorted({t for *_, q in compiled for s in _literals(q) for t in _trigrams(s)}), np.int64)
        table = marked(wanted)
        for batch in batches:
            for part in slices(batch, "text"):
                segment, texts = Segment(part.column("text"), wanted, table), part.column("text")
                finds: dict[int, list[tuple[int, int, int]]] = {}
                for i, rule, pattern, query in compiled:
                    for row in segment.find(query).tolist():
                        for m in pattern.finditer(texts[row].as_py() or ""):
                            if m.end(rule.group) - m.start(rule.group) >= rule.min_chars:
                                finds.setdefault(row, []).append((m.start(), i, m.end()))
                counts = {k: [0] * part.num_rows for k in base_kinds}
                digest, listed = [""] * part.num_rows, [""] * part.num_rows
                empty = hashlib.sha256(b"").hexdigest()
                for row in range(part.num_rows):
                    found = sorted(finds.get(row, ()))
                    named = [(rules[i].kind, f"{rules[i].kind}:{s}:{e}") for s, i, e in found]
                    own = [text for kind, text in named if kind in counts]
                    for kind, _ in named:
                        if kind in counts:
                            counts[kind][row] += 1
                    digest[row] = hashlib.sha256(",".join(own).encode()).hexdigest() if own else empty
                    listed[row] = ",".join(text for _, text in named)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(counts[k], pa.int64()) for k in base_kinds), pa.array(digest), pa.array(listed)], names=[id_col, *(f"n_{k}" for k in base_kinds), "base_sha256", "spans"]
                )

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in base_kinds) + ", base_sha256 string, spans string")
