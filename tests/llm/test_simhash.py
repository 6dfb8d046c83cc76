"""SimHash links against all pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import frame
from statewise.llm import simhash
from statewise.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(values):
    """Least value reachable from each over pairs that differ in at most two bits."""
    at = {v: v for v in values}
    own = sorted(at)
    near = {v: [w for w in own if (v ^ w).bit_count() <= 2] for v in own}
    while True:
        new = {v: min(at[w] for w in near[v]) for v in own}
        if new == at:
            return at
        at = new


def test_documents_against_all_pairs(spark):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bits = [(i, _fingerprint(t)) for i, t in rows]
    reach = _components({b for _, b in bits})
    least = defaultdict(lambda: None)
    for i, b in bits:
        if i is not None:
            least[reach[b]] = i if least[reach[b]] is None else min(i, least[reach[b]])
    want = Counter((i, f"{b:016x}", least[reach[b]]) for i, b in bits)
    got = Counter(tuple(r) for r in simhash.simhash_components(docs).collect())
    assert got == want
    assert len({c for _, _, c in got}) < len(got) - 5
    assert simhash.simhash_components(docs.filter("doc_id < 0")).count() == 0


def _crafted():
    """Chains of one and two flips, a group that shares its high half, one that shares its low half, both far larger than a key may have."""
    rng = np.random.default_rng(3)
    values = {0, 1, 3, (1 << 64) - 1, 1 << 63, 1 << 31, 1 << 32}
    for _ in range(60):
        v = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 12))):
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                v ^= 1 << int(b)
            values.add(v)
    high, low = 0xABCD1234 << 32, 0x77777777
    for _ in range(150):
        small = int(sum(1 << int(b) for b in set(rng.integers(0, 32, 3).tolist())))
        values |= {high | small, high ^ (1 << 40) | small, low | small << 32}
    return values


@pytest.mark.parametrize("bucket", [3, 1024])
def test_links_close_to_the_components_of_all_pairs(spark, bucket):
    values = _crafted()
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long").repartition(4)
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(nodes, bucket).collect()]
    found = connected_components(simhash.links(nodes, bucket))
    group = {r["id"] % (1 << 64): r["component"] for r in found.collect()}
    want = _components(values)
    sizes = Counter(want.values())
    assert set(group) == {v for v in values if sizes[want[v]] > 1}
    assert len({(want[v], group[v]) for v in group}) == len({want[v] for v in group}) == len(set(group.values()))
    assert all(want[u] == want[v] for u, v in links)


def test_blocks_of_votes_do_not_change_a_fingerprint():
    rng = np.random.default_rng(5)
    row, hashes = np.sort(rng.integers(0, 9, 500)), rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    whole = simhash.fingerprints_of(row, hashes, 12)
    assert (simhash.fingerprints_of(row, hashes, 12, block=7) == whole).all() and (whole[9:] == 0).all()


def test_ties_at_half_the_hashes_are_not_set(spark):
    out = simhash.fingerprints_of(np.array([0, 0]), np.array([3, 1], np.uint64), 1)
    assert out.tolist() == [1]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"] % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)
