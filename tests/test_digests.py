"""Hashes of pairs taken as arrays in the tasks that make the pairs."""

import hashlib

import numpy as np
import pytest

from statewise.functions.digests import laid, leads
from statewise.operators import inference, pairs


def _lead(text):
    return int(hashlib.md5(text).hexdigest()[:8], 16)


@pytest.mark.parametrize("size", [1, 3, 4, 11, 12, 13, 31, 47])
def test_leads_are_those_of_md5(size):
    rng = np.random.default_rng(size)
    texts = [bytes(rng.integers(1, 256, size, dtype=np.uint8)) for _ in range(50)]
    tails = [b"1:0", b"50:0", b"", b"7:12345"]
    for tail, got in zip(tails, leads(list(laid(texts, 0)[: -(-size // 4)]), size, tails), strict=True):
        assert got.tolist() == [_lead(t + tail) for t in texts]


def test_texts_of_more_than_a_block_are_refused():
    with pytest.raises(ValueError):
        list(leads(list(laid([b"x" * 54], 0)), 54, [b"1:0"]))


@pytest.mark.parametrize("block_rows", [None, 3])
def test_bootstrap_of_overlaps_without_rows_for_pairs(spark, block_rows):
    rng = np.random.default_rng(3)
    ids = [-7, 0, 5, 9, 10, 99, 100, 12345, 99999, 100000, 2**62]
    rows = [(s, t, int(rng.integers(0, 3))) for n, s in enumerate(ids) for t in range(n % 4, n % 4 + 9)] + [(77, 1000, 1)]
    seq = spark.createDataFrame(rows, "subject long, t long, state int")
    want = inference.weighted_bootstrap(pairs.pair_overlap(seq), ["a", "b"], "overlap", 20).first().asDict()
    got = inference.overlap_bootstrap(seq, 20, block_rows=block_rows).first().asDict()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    none = inference.overlap_bootstrap(seq.filter("subject = 5"), 20).first()
    assert none["n"] == 0 and none["mean"] is None and none["ci_lower"] is None
