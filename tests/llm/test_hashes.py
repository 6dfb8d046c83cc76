"""Texts built to collide under any polynomial modulo a power of two are told apart by every operator that compares spans."""

import numpy as np

from statewise.llm import decontamination, jaccard_join, quality_rules, suffix_dedup
from statewise.llm.textscan import SpanHash, same_bytes

ODD = [bin(i).count("1") % 2 for i in range(4096)]  # the Thue-Morse sequence
X, Y = "".join("ab"[o] for o in ODD[:1024]), "".join("ba"[o] for o in ODD[:1024])


def test_spans():
    for n in (128, 1024, 4096):
        buf = np.frombuffer(("".join("ab"[o] for o in ODD[:n]) + "".join("ba"[o] for o in ODD[:n])).encode(), np.uint8)
        spans = SpanHash(buf)
        a, b = spans(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b and (int(a) ^ int(b)) & ((1 << 36) - 1)
    buf = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    start = np.arange(4900)
    h = SpanHash(buf)(start, start + 6)
    content = [bytes(buf[i : i + 6]) for i in start]
    assert len(set(h.tolist())) == len(set(content)) == len(set(zip(content, h.tolist())))
    assert same_bytes(buf, start[:50], start[50:100], np.full(50, 3)).tolist() == [content[i][:3] == content[i + 50][:3] for i in range(50)]


def test_jaccard_join(spark):
    docs = spark.createDataFrame([(1, X), (2, Y), (3, X)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 1, 0), 3: (1, 2, 1)}
    assert {r["doc_id"] for r in jaccard_join.drop_near_copies(docs).collect()} == {1, 2}


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, f"{X} and more"), (2, Y)], "doc_id long, text string")
    items = spark.createDataFrame([(7, X)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items).collect()} == set()
    same = spark.createDataFrame([(7, X)], "doc_id long, text string")
    assert decontamination.find_items(same, items).count() == 1


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, f"{X}\n{Y}"), (2, f"{X}\n{Y}\n{X}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.repetition_report(docs).collect()} == {1: 0, 2: 1}


def test_suffix_dedup(spark):
    docs = spark.createDataFrame([(1, X), (2, Y)], "doc_id long, text string")
    both = (X + "|" + Y).encode()
    seen: set[bytes] = set()
    gone = np.zeros(len(both), bool)
    for text in (range(0, 1024 - 99), range(1025, 2049 - 99)):
        for i in text:
            w = both[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: int(gone[:1024].sum()), 2: int(gone[1025:].sum())}
    hot = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs, hot_segments=0).collect()}
    assert hot == got
