"""The mix against a recomputation of its draws in Python, and its packed blocks against the texts."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statewise.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def _rows():
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(5 + i * 7 % 60)), f"s{i % 5}" if i % 11 else None) for i in range(300)]
    return rows + [(900, None, "s1"), (901, "", "empty"), (902, "one", "tiny"), (903, "a b\tc\n\nd", "tiny"), (903, "a b\tc\n\nd", "tiny")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit(1) for c in ("id", "key", "range", "block", "row", "tie", "n", "words", "at", "__id", "__n", "__copies")}
    return spark.createDataFrame(_rows(), SCHEMA).withColumns(extra).repartition(5).cache()


def _targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, full = {s: weights[i % 3] for i, s in enumerate(names)}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_targets_are_the_water_level(docs):
    sizes = Counter()
    for _, text, source in _rows():
        sizes[source] += len(WORD.findall(text or ""))
    table = docs.sparkSession.createDataFrame([("null" if s is None else "=" + s, s, n) for s, n in sizes.items()], "key string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = _targets(dict(sizes))
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_blocks_are_the_drawn_words(docs):
    """Every document's `taken` recomputed from the packed blocks that were delivered, and shards without gaps."""
    options = {"block_words": 16, "shards": 4}
    blocks = mixing.mixed_blocks(docs, **options).collect()
    by_shard = defaultdict(list)
    for b in blocks:
        by_shard[b["shard"]].append(b)
        assert b["text"].split(" ") == WORD.findall(b["text"]) and len(b["text"].split(" ")) == b["n_words"] <= 16
    assert set(by_shard) == set(range(4)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    mixed = mixing.mix(docs, **options).collect()
    words, sources = Counter(w for b in blocks for w in b["text"].split(" ")), defaultdict(set)
    for doc_id, text, source in _rows():
        sources[source] |= set(WORD.findall(text or ""))
    per_doc = Counter()
    for r in mixed:
        per_doc[r["doc_id"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] // r["size"] <= r["copies"] <= -(-r["taken"] // r["size"]))
    for doc_id, text, _ in _rows()[:300]:
        assert per_doc[doc_id] == sum(words[w] for w in WORD.findall(text))
    # a pass takes each block once; the shards' counts of a source add up to its slots, next to its target
    assert len({(b["source"], b["block"], b["pass"]) for b in blocks}) == len(blocks)
    sizes = {s: r for r in mixed for s in [r["source_size"]]}
    taken = Counter()
    for b in blocks:
        taken[b["source"]] += b["n_words"]
    total = Counter()
    for _, text, source in _rows():
        total[source] += len(WORD.findall(text or ""))
    for s, target in _targets(dict(total)).items():
        assert abs(taken[s] - target) <= 16 + 0.02 * target
    assert len(sizes) > 1


def test_shards_draw_their_sources_at_random(docs):
    """Counts of the shards scatter as draws without replacement from the deck do, and change with the seed."""
    def counts(seed):
        rows = mixing.mixed_blocks(docs, block_words=4, shards=20, seed=seed).groupBy("shard", "source").count().collect()
        return {(r["shard"], r["source"]): r["count"] for r in rows}

    one, two = counts(1), counts(2)
    assert one != two
    whole, per = Counter(), Counter()
    for (shard, source), n in one.items():
        whole[source] += n
        per[shard] += n
    deck, shards = sum(whole.values()), 20
    score = 0.0
    for source, n in whole.items():
        if n >= 200:
            p = n / deck
            variance = deck / shards * p * (1 - p) * (1 - 1 / shards)
            score += sum((one.get((s, source), 0) - n / shards) ** 2 for s in range(shards)) / variance / (shards - 1) - 1
    assert abs(score) < 3  # sum over five sources of relative deviations of a variance from 19 degrees of freedom


def test_whole_documents_follow_the_mix(docs):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    wanted = Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +wanted
    assert mixing.apply_mix(docs.filter("doc_id < 0")).count() == 0
    assert mixing.mixed_blocks(docs.filter("doc_id < 0")).count() == 0
