"""The whole mix written out in plain Python from its description: order of words, deck, permutations, blocks and words taken."""

import math
import re
import zlib
from collections import Counter

import xxhash

from statewise.llm import mixing
from statewise.llm.shared import spread_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS, SHARDS, SEED = 16, 4, 23


def _hash(*values):
    """Each value hashed with the hash before it as seed, the first with 42; an int as 4 bytes, a 1-tuple of one as 8."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _permuted(i, n, *salt):
    for r in range(1, 13):
        other = (_hash(r, "shift", *salt) % n - i) % n
        if _hash(r, (max(i, other),), *salt) & 1:
            i = other
    return i


def _targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full = set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: 3 * sizes[s] for s in names}
        level = (sum(sizes.values()) - 3 * sum(sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def _mix(rows, ranges):
    key = lambda s: "null" if s is None else "=" + s
    texts, sizes = {}, Counter()
    placed = {}
    for doc_id, text, source in rows:
        tie, words = zlib.crc32((text or "").encode()), WORD.findall(text or "")
        placed.setdefault(source, []).append((_hash((doc_id,), (tie,)) % ranges, doc_id, len(words), tie, words))
        sizes[source] += len(words)
    targets, spans = _targets(sizes), []
    for source, own in placed.items():
        line = []
        for _, doc_id, n, _, words in sorted(own, key=lambda r: r[:4]):
            spans.append((source, doc_id, len(line), len(line) + n))
            line += words
        texts[source] = line
    blocks = {s: math.ceil(n / WORDS) for s, n in sizes.items()}
    slots = {s: min(math.floor(targets[s] * blocks[s] / n + 0.5), 3 * blocks[s]) if n else 0 for s, n in sizes.items()}
    deck, out, first = sum(slots.values()), [], 0
    for source in sorted(slots, key=lambda s: (_hash(key(s)) % ranges, key(s))):
        for k in range(slots[source]):
            turn, at = k // blocks[source], _permuted(first + k, deck, SEED, "deck")
            block = _permuted(k % blocks[source], blocks[source], SEED, key(source), (turn,))
            shard = at * SHARDS // deck
            out.append((shard, at - math.ceil(shard * deck / SHARDS), str(source), block, turn, " ".join(texts[source][block * WORDS : (block + 1) * WORDS])))
        first += slots[source]
    times = Counter((r[2], r[3]) for r in out)
    taken = [(doc_id, end - start, sum(times[str(s), p // WORDS] for p in range(start, end))) for s, doc_id, start, end in spans]
    return sorted(out), sorted(taken)


def test_mix_equals_the_plain_one(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(3 + i * 7 % 50)), f"s{i % 5}" if i % 11 else None) for i in range(160)]
    rows += [(900, None, "s1"), (901, "", "empty"), (902, "one", "tiny"), (903, "a b\tc\n\nd", "tiny"), (903, "a b\tc\n\nd", "tiny"), (904, "é ü", "ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    blocks, taken = _mix(rows, spread_of(spark))
    options = {"block_words": WORDS, "shards": SHARDS, "seed": SEED}
    got = mixing.mixed_blocks(docs, **options).collect()
    assert sorted((r["shard"], r["slot"], str(r["source"]), r["block"], r["pass"], r["text"]) for r in got) == blocks
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, **options).collect()) == taken
