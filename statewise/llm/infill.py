"""Fill-in-middle transformation of whole texts by displacement scatter, and its inverse.

A slice of texts is one byte array.  One scan finds the tokens (runs of ASCII
letters, else single code points) and with them the bytes of every text's two
cuts.  Prefix, middle and suffix move as wholes, so a byte's place in the output
is its own place plus a shift that changes only at cuts: a difference array
holds the changes, its cumulative sum is the shift of every byte of the slice,
and one scatter writes all outputs.  `restore` reads the marks of the outputs,
builds the inverse shifts the same way and gathers the texts back.  No row meets
another, so nothing is shuffled.

Defined cases: null counts as empty; an empty text, a text that holds a mark and
a text outside the drawn share are plain, their output is the text; the draws of a
row depend on its id alone (a null id counts as an empty one), so repeated ids
draw alike; repeated rows each get their own result; a text of any length is
handled in one task, with some 60 bytes of memory a byte; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import over_cores
from .textscan import pack, slices

#: Marks before prefix, suffix and middle, as three bytes each.
MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = [np.frombuffer(m.encode(), np.uint8) for m in MARKS]
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])


def _marks_at(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, which of MARKS) of every mark that lies inside one row."""
    at = np.flatnonzero((buf[:-2] == 60) & (buf[2:] == 62)) if len(buf) > 2 else np.zeros(0, np.int64)
    letter = buf[at + 1]
    which = np.select([letter == m[1] for m in _MARK], [0, 1, 2], -1)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = (which >= 0) & (at + 3 <= offsets[row + 1])
    return at[inside], row[inside], which[inside]


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every token, and each row's first token (one more than rows)."""
    letter = _LETTER[buf]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    begin = offsets[:-1][offsets[:-1] < len(buf)]
    inner[begin] = False
    first = np.flatnonzero(~inner & ((buf & 0xC0) != 0x80))
    return first, np.searchsorted(first, offsets)


def _shifts(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Shift of every one of `size` places, given where segments start (ascending, possibly empty ones) and their shifts."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change)[:size]


def cut_texts(column: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray, plain_pct: int, spm_pct: int) -> pa.RecordBatch:
    """n, form, prefix_chars, middle_chars, output of each row of a slice."""
    buf, offsets = pack(column)
    rows, length = len(offsets) - 1, np.diff(offsets)
    first, token_of_row = _tokens(buf, offsets)
    n = np.diff(token_of_row)
    low, high = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(low, high), np.maximum(low, high)
    place = np.append(first, len(buf))
    ends = offsets[1:]
    a = np.where(low < n, place[token_of_row[:-1] + low], ends)
    b = np.where(high < n, place[token_of_row[:-1] + high], ends)

    form = np.where(h4 % 100 < spm_pct, SPM, PSM)
    form[(length == 0) | (h3 % 100 >= plain_pct)] = PLAIN
    form[_marks_at(buf, offsets)[1]] = PLAIN
    moved = form != PLAIN
    out_offsets = np.concatenate([[0], np.cumsum(length + 9 * moved)])
    base = out_offsets[:-1] - offsets[:-1]
    p, m, s = a - offsets[:-1], b - a, ends - b
    # shift of prefix, middle and suffix: where each goes in its row's output less where it was
    kinds = [form == PSM, form == SPM]
    to_p = np.select(kinds, [3, 6 + s], 0) + base
    to_m = np.select(kinds, [9 + s, 9 + s], 0) + base
    to_s = np.select(kinds, [6 - m, 3 - p - m], 0) + base
    starts = np.stack([offsets[:-1], a, b], 1).ravel()
    shift = _shifts(len(buf), starts, np.stack([to_p, to_m, to_s], 1).ravel())
    out = np.empty(out_offsets[-1], np.uint8)
    out[np.arange(len(buf)) + shift] = buf
    for mark, start in zip(_MARK, (offsets[:-1] + to_p, b + to_s, a + to_m)):  # each stands before its segment
        out[(start[moved] - 3)[:, None] + np.arange(3)] = mark

    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    shown = ~moved
    return pa.RecordBatch.from_arrays(
        [
            pa.array(n.astype(np.int64)), pa.array(FORMS[form]), pa.array((points[a] - points[offsets[:-1]]).astype(np.int64), mask=shown),
            pa.array((points[b] - points[a]).astype(np.int64), mask=shown), texts_of(out, out_offsets),
        ],
        names=["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def rebuilt_texts(column: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that the outputs of a slice were made of, from the outputs and their forms alone."""
    buf, offsets = pack(column)
    moved = form != PLAIN
    at, row, which = _marks_at(buf, offsets)
    mine = moved[row]
    place = np.zeros((len(moved), 3), np.int64)
    place[row[mine], which[mine]] = at[mine]
    mark_p, mark_s, mark_m = place.T
    begin, end = offsets[:-1], offsets[1:]
    length = np.diff(offsets) - 9 * moved
    text_offsets = np.concatenate([[0], np.cumsum(length)])
    p = np.select([form == PSM, form == SPM], [mark_s - mark_p - 3, mark_m - mark_p - 3], length)
    m = np.where(moved, end - mark_m - 3, 0)
    to = text_offsets[:-1]
    from_p, from_m = np.where(moved, mark_p + 3, begin), np.where(moved, mark_m + 3, end)
    from_s = np.where(moved, mark_s + 3, end)
    starts = np.stack([to, to + p, to + p + m], 1)
    shift = _shifts(int(text_offsets[-1]), starts.ravel(), (np.stack([from_p, from_m, from_s], 1) - starts).ravel())
    return texts_of(buf[np.arange(text_offsets[-1]) + shift], text_offsets)


def texts_of(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over bytes that lie end to end."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf)).cast(pa.string())


def _draw(hexadecimal, i: int):
    return F.conv(F.substring(hexadecimal, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, moved_pct: int = 90, spm_pct: int = 20, salt: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (tokens), form, prefix_chars, middle_chars, output.

    The cuts and the form are drawn from the SHA-256 of `salt`, a colon and the
    id.  `moved_pct` percent of the rows are transformed, `spm_pct` percent of
    them with the suffix first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = over_cores(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    code = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = slim.withColumn("code", code).select("id", "text", *[_draw(F.col("code"), i).alias(f"h{i + 1}") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = cut_texts(part.column("text"), *[part.column(f"h{i + 1}").to_numpy() for i in range(4)], moved_pct, spm_pct)
                yield pa.RecordBatch.from_arrays([part.column("id"), *made.columns], names=["id", *made.schema.names])

    made = drawn.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """`made` with the texts that its outputs were made of, rebuilt from `output_col` and `form_col` alone."""
    schema = T.StructType([*made.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output_col):
                form = np.searchsorted(FORMS, part.column(form_col).to_numpy(zero_copy_only=False).astype(str))
                yield pa.RecordBatch.from_arrays([*part.columns, rebuilt_texts(part.column(output_col), form)], names=[*part.schema.names, name])

    return made.mapInArrow(run, schema)
