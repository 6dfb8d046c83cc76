"""Merkle manifest against a plain recursion, its proofs and what they must reject."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import frame
from statewise.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _fold(nodes, k):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
    return levels


def _proof(levels, slot, k):
    out = []
    for level in levels[:-1]:
        at = slot // k * k
        run = level[at : at + k]
        out.append((slot % k, "".join(run[: slot - at] + run[slot - at + 1 :])))
        slot //= k
    return out


def _manifest(rows, k):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r[0], r[2], r[3], r[4], r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: _fold([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], k) for s in order}
    top = _fold([levels[s][-1][0] for s in order], k)
    for at, s in enumerate(order):
        for slot, x in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = _proof(levels[s], slot, k) + _proof(top, at, k)
            yield x[3][0], x[2], levels[s][-1][0], top[-1][0], tuple(path)


@pytest.mark.parametrize("fan_out", [2, 16])
def test_against_a_plain_recursion(spark, fan_out):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").collect()]
    want = Counter(_manifest(rows, fan_out))
    made = merkle.manifest(docs, fan_out)
    got = made.select("doc_id", "leaf", "subroot", "root", "path", merkle.folded(F.col("leaf"), F.col("path")).alias("again")).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(tuple(x) for x in r["path"])) for r in got) == want
    assert all(r["again"] == r["root"] for r in got)


def test_changed_rows_and_changed_proofs_are_found(spark):
    docs = frame(spark)
    hit = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    made = merkle.manifest(docs, changed=F.when(hit, F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    got = made.select("doc_id", "leaf", "changed_leaf", "root", merkle.folded(F.col("changed_leaf"), F.col("path")).alias("folded")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    bad = {r["doc_id"] for r in got if r["folded"] != r["root"]}
    assert bad == {i for i, t in texts.items() if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in t or "")}
    assert bad and all((r["leaf"] != r["changed_leaf"]) == (r["doc_id"] in bad) for r in got)
    other = made.filter(F.size("path") > 0).select("root", merkle.folded(F.col("leaf"), F.reverse("path")).alias("f"), F.size("path").alias("n")).filter("n > 1").collect()
    assert all(r["f"] != r["root"] for r in other)


def test_small_tables(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    one = merkle.manifest(spark.createDataFrame([(5, "x", None, None, 1)], schema)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    two = merkle.manifest(spark.createDataFrame([(5, "x", None, None, 1), (6, "y", "s", None, 1)], schema)).collect()
    assert all(r["subroot"] == r["leaf"] and len(r["path"]) == 1 for r in two) and len({r["root"] for r in two}) == 1
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0


def test_a_key_that_holds_most_rows_over_many_parts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("source"), F.lit("l").alias("lang"), F.lit(1).cast("long").alias("n_chars"))
    rows = [(i, "t", "hot" if i % 10 else str(i), "l", 1) for i in range(3000)]
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(tuple(x) for x in r["path"])) for r in merkle.manifest(df.repartition(7)).collect())
    assert got == Counter(_manifest(rows, 16))
