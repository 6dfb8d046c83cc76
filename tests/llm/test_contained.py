"""Recall of the containment search at the threshold, with items whole, cut short and scattered, and items in several parts."""

import random

from statewise.llm import decontamination


def test_items_at_and_beside_the_threshold(spark):
    rng = random.Random(4)
    items, docs, want = [], [], {}
    for k in range(60):
        size = rng.choice([6, 12, 30, 75, 200])
        words = [f"i{k}_{j}" for j in range(size)]
        items.append((k, " ".join(words)))
        for keep in (1.0, 0.9, 0.82, 0.7, 0.4):
            cut = words[: max(5, round(keep * (size - 4)) + 4)]
            filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
            at = len(docs)
            if rng.random() < 0.5:
                text = filler(rng.randrange(300)) + cut + filler(rng.randrange(300))
            else:  # two halves that overlap by four words, far apart but within one window of the item's partition
                half = len(cut) // 2
                text = filler(50) + cut[: half + 4] + filler(3) + cut[half:] + filler(200)
            docs.append((at, " ".join(text)))
            of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            share = len(of(words) & of(text)) / len(of(words))
            if share >= 0.8:
                want[(at, k)] = share
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (32 << 20, 4_000):
        got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.find_items(d, i, part_bytes=part_bytes).collect()}
        assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
        assert len(got) >= 0.99 * len(want)
        left = decontamination.drop_contaminated(d, i, part_bytes=part_bytes)
        assert left.count() == len(docs) - len({p[0] for p in got})


def test_ids_and_names(spark):
    docs = spark.createDataFrame([("x", "a b c d e f", 1, 2), (None, "q a b c d e f", 1, 2), ("y", None, 1, 2)], "doc_id string, text string, id int, item int")
    items = spark.createDataFrame([("one", "a b c d e f", 0), (None, "q a b c d", 0)], "item_id string, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items).collect()}
    assert got == {("x", "one"), (None, "one"), (None, None)}
