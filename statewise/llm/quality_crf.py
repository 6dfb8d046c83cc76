"""Line quality by a linear-chain conditional random field.

Every line with a word is a place in the chain of its document, labelled good
or bad; its features and those of the lines before and after it enter the
score, and transitions tie neighbours.  A document's quality is the mean of its
lines' forward-backward marginals of "good", weighted by their length.

The field is fitted on at most `sample_rows` labelled documents (the first in
hash order of the training rows; a documented bound), whose lines take their
document's label.  Scoring covers every row, each in the task that reads it.

Defined cases: a text without words (null, empty) scores the sample's share of
label 1; without labels, or with one label only, the field is flat and every
score is that share (0.5 without labels); repeated rows get equal scores; a
document labelled twice counts by its larger label; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import SpanHash, Words, in_row_order, ngrams, pack, slices


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _SHOUT, _STOP, _BAR = _table(b"#*$%&<>"), _table(b"!?"), _table(b".,;:"), _table(b"|")
_DIGIT, _UPPER = _table(b"0123456789"), _table(bytes(range(65, 91)))
N_FEATURES = 13


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length in characters, features) of each line with a word, lines in order."""
    buf, offsets = pack(column)
    words, spans = Words(buf, offsets), SpanHash(buf)
    hashes = words.hash(spans)
    cuts = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begin = begin[begin < len(buf)]
    stop = np.concatenate([begin[1:], [len(buf)]])[: len(begin)]
    lo, hi = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    held = hi > lo
    begin, stop, lo, hi = begin[held], stop[held], lo[held], hi[held]
    row = np.searchsorted(offsets, begin, side="right") - 1
    if not len(begin):
        return row, np.zeros(0), np.zeros((0, N_FEATURES))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[stop] - total[begin]).astype(float)

    def of_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[hi] - total[lo]).astype(float)

    lead = (buf & 0xC0) != 0x80
    capital = _UPPER[buf].copy()
    capital[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    chars, n = count(lead & words.solid), (hi - lo).astype(float)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    at, value = ngrams(words, hashes, 3)
    order, again = in_row_order(words.row[at], value)
    twice = again.copy()
    twice[:-1] |= again[1:]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[order[twice]], 1)
    np.add.at(edge, at[order[twice]] + 3, -1)
    order, again = in_row_order(row, spans(begin, stop))
    dup = np.zeros(len(begin))
    dup[order[again]] = 1
    last = buf[words.end[hi - 1] - 1]
    x = np.stack(
        [
            np.log1p(n), chars / n / 10, count(_SYMBOL[buf]) / n, count(capital) / chars, count(_DIGIT[buf]) / chars, count(_SHOUT[buf]) / n, count(_STOP[buf]) / n,
            count(_BAR[buf]) / n, of_words(same) / n, of_words(np.cumsum(edge[:-1]) > 0) / n, dup, (last == ord(".")).astype(float), np.abs(chars / n - 5) / 5,
        ],
        1,
    )
    return row, chars, x


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of the line, of the line before and of the line after (0 at the document's edges), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = row[1:] == row[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


@dataclass
class Field:
    """Weights of "good" against "bad", transition scores, and the scale of the features."""

    weights: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, row: np.ndarray, chars: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        out = np.full(rows, self.prior)
        if len(row):
            good, _ = marginals(row, with_neighbours(row, (x - self.mean) / self.scale) @ self.weights, self.transition)
            total = np.bincount(row, chars, rows)
            have = total > 0
            out[have] = np.bincount(row, chars * good, rows)[have] / total[have]
        return np.clip(out, 0.0, 1.0)


def marginals(row: np.ndarray, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transition counts (2 x 2), by forward-backward over all documents at once."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.concatenate([first, [len(row)]]))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    score = np.stack([np.zeros(len(row)), emission], 1)
    alpha, beta = score.copy(), np.zeros_like(score)
    for t in range(1, length[0]):
        at = first[: active[t]] + t
        a = alpha[at - 1]
        alpha[at] = np.logaddexp(a[:, :1] + transition[0], a[:, 1:] + transition[1]) + score[at]
    for t in range(length[0] - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = beta[at + 1] + score[at + 1]
        beta[at] = np.logaddexp(b[:, :1] + transition[:, 0], b[:, 1:] + transition[:, 1])
    joint = alpha + beta
    norm = np.logaddexp(joint[:, 0], joint[:, 1])
    inner = np.flatnonzero(row[1:] == row[:-1])
    pair = alpha[inner][:, :, None] + transition[None] + (score + beta)[inner + 1][:, None, :] - norm[inner][:, None, None]
    return np.exp(joint[:, 1] - norm), np.exp(pair).sum(0) if len(inner) else np.zeros((2, 2))


def fit(row: np.ndarray, x: np.ndarray, label: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge by Adam; `label` is 0/1 for each line."""
    width = 3 * N_FEATURES + 1
    flat = Field(np.zeros(width), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)
    if not len(row) or label.min() == label.max():
        return flat
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    wide = with_neighbours(row, (x - mean) / scale)
    inner = np.flatnonzero(row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), 1)
    params, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        good, expected = marginals(row, wide @ params[:width], params[width:].reshape(2, 2))
        grad = np.concatenate([wide.T @ (label - good), (seen - expected).ravel()]) / len(row) - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(params[:width], params[width:].reshape(2, 2), mean, scale, prior)


def in_held_out(doc_id: Column) -> Column:
    """The fold that no training row is taken from: crc32 of the id as text, modulo 3, is 1 (a null id: no)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit the field on labelled documents outside the held-out fold, `sample_rows` at most."""
    known = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = F.broadcast(known.filter(~in_held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, chars, x = line_features(part.column("text"))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                data = [x[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(data, pa.binary())], names=["id", "label", "x"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample, "id")
    rows = sorted(slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, label int, x binary").collect(), key=lambda r: (r["id"], r["x"]))
    if not rows:
        return fit(np.zeros(0, np.int64), np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), 0.5)
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows]
    lengths = [len(p) for p in parts]
    target = np.array([r["label"] for r in rows])
    return fit(np.repeat(np.arange(len(rows)), lengths), np.concatenate(parts), np.repeat(target, lengths), float(target.mean()))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value = field.scores(*line_features(part.column("text")), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
