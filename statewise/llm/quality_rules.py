"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths are taken over a whole text;
the share of its characters that lie inside n-grams (or lines) seen earlier in
the same text tells boiler-plate loops from prose.  One pass, no shuffle: every
row is judged on its own text.

Defined cases: null and empty texts have no words and fail; a text shorter than
an n-gram has none of that length; repeated rows give repeated results; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import SpanHash, Words, in_row_order, ngrams, pack, same_bytes, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RuleLimits:
    """A text is kept while every share stays at or under its limit."""

    min_words: int = 50
    max_repeat_words_pct: int = 50
    max_dup_line_chars: float = 0.30
    max_dup_ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.25, 10: 0.20})
    max_symbols_per_word: float = 0.30
    max_word_chars: float = 20.0


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_ngram_chars"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars double, dup_ngram_chars array<double>"


def _cover(at: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array, limits: RuleLimits) -> dict[str, np.ndarray]:
    """All measures of the texts of one slice."""
    buf, offsets = pack(column)
    rows = len(offsets) - 1
    words, spans = Words(buf, offsets), SpanHash(buf)
    hashes = words.hash(spans)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = lead[words.end] - lead[words.start]
    word_chars = np.bincount(words.row, chars, rows).astype(np.int64)
    safe = np.maximum(word_chars, 1)

    def share(covered: np.ndarray) -> np.ndarray:
        return np.bincount(words.row[covered], chars[covered], rows) / safe

    # lines: cut at \n and at row edges, only those that hold a word count
    cuts = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begin = begin[begin < len(buf)]
    row = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.concatenate([begin[1:], [len(buf)]])[: len(begin)]
    stop = stop - ((stop > begin) & (buf[stop - 1] == 10)) if len(begin) else stop
    held = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop, row = begin[held], stop[held], row[held]
    order, same = in_row_order(row, spans(begin, stop))
    near = np.flatnonzero(same)  # of equal hash: equal in bytes too
    one, other = order[near - 1], order[near]
    size = stop - begin
    equal = (row[one] == row[other]) & (size[one] == size[other])
    equal[equal] = same_bytes(buf, begin[one[equal]], begin[other[equal]], size[one[equal]])
    again = other[equal]
    n_dup_lines = np.bincount(row[again], minlength=rows)
    line_edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(line_edge, np.searchsorted(words.start, begin[again]), 1)
    np.add.at(line_edge, np.searchsorted(words.start, stop[again]), -1)
    dup_line_chars = share(np.cumsum(line_edge[:-1]) > 0)

    at, value = ngrams(words, hashes, 3)
    order, same = in_row_order(words.row[at], value)
    twice = same.copy()
    twice[:-1] |= same[1:]
    n_repeat = np.bincount(words.row[_cover(at[order[twice]], 3, len(hashes))], minlength=rows)

    shares = []
    for n in limits.max_dup_ngram_chars:
        at, value = ngrams(words, hashes, n)
        order, same = in_row_order(words.row[at], value)
        shares.append(share(_cover(at[order[same]], n, len(hashes))))
    n_words, n_symbols = words.per_row, per_row(_SYMBOL[buf])
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_words_pct * n_words)
    kept = ~base_failed & (dup_line_chars <= limits.max_dup_line_chars)
    kept &= n_symbols <= limits.max_symbols_per_word * n_words
    kept &= word_chars <= limits.max_word_chars * n_words
    for limit, part in zip(limits.max_dup_ngram_chars.values(), shares):
        kept &= part <= limit
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": kept, "dup_line_chars": dup_line_chars, "dup_ngram_chars": np.stack(shares, 1) if shares else np.zeros((rows, 0)),
    }


def repetition_report(docs: DataFrame, limits: RuleLimits = RuleLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the measures and the verdict `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"), limits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id")] + [pa.array(m[k].tolist(), pa.list_(pa.float64())) if m[k].ndim == 2 else pa.array(m[k]) for k in MEASURES], names=[id_col, *MEASURES]
                )

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def keep_by_rules(docs: DataFrame, limits: RuleLimits = RuleLimits(), text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns unchanged, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(measure(part.column(text_col), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
