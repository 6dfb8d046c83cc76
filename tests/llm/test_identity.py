"""Near copies among rows whose ids are repeated or missing."""

from statewise.llm import jaccard_join

SCHEMA = "doc_id long, text string"


def _near(name, i):
    return " ".join(f"{name}{w}" if w != 7 * i + 3 else f"x{i}" for w in range(200))


def test_rows_of_one_id_are_told_apart(spark):
    # id 5 stands at texts of two families, and the smaller ids of both are elsewhere
    rows = [(5, _near("a", 0)), (5, _near("b", 0)), (6, _near("a", 1)), (3, _near("b", 1)), (5, "")]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == [(3, 3, 1), (5, 3, 1), (5, 5, 0), (5, 5, 1), (6, 5, 1)]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[3], rows[4]])


def test_rows_without_an_id_are_compared(spark):
    rows = [(None, _near("a", i)) for i in range(4)] + [(None, _near("b", 0)), (None, _near("b", 0)), (9, _near("b", 1)), (None, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["class_id"] or 0, r["n_copies"], r["n_links"]) for r in jaccard_join.jaccard_groups(df).collect())
    assert got == [(0, 1, 0)] * 3 + [(0, 1, 3)] * 4 + [(9, 1, 2)] + [(9, 2, 2)] * 2
    kept = [tuple(r) for r in jaccard_join.drop_near_copies(df).collect()]
    assert sum(t is not None and t.startswith(("a0", "x")) for _, t in kept) == 1
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in kept if r[1] and "a9" in r[1]] + [(9, _near("b", 1)), (None, None), (None, None), (None, "")]))


def test_ids_of_other_types_and_taken_names(spark):
    rows = [("k5", _near("a", 0)), ("k2", _near("a", 1)), ("k9", _near("b", 0)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as id", "2 as __id", "3 as __code", "true as __held", "4 as node", "5 as band", "6 as bands")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.jaccard_groups(df).collect())
    assert got == [("None", "None", 0), ("k2", "k2", 1), ("k5", "k2", 1), ("k9", "k9", 0)]
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["None", "k2", "k9"]


def test_a_chain_of_buckets_is_compared_bucket_by_bucket(spark):
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(120)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for _, t in rows]
    want = [sum(i != j and 9 * len(a & b) >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # blocks of two rows: the component has more blocks than there are bands
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_groups(df, block_rows=2).collect()}
    assert {r["class_id"] for r in got.values()} == {0}
    # pairs next to the threshold share a bucket with the stated recall, 0.997
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= want[i] for i in got) and found >= 0.997 * sum(want)
    whole = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_groups(df).collect()}
    assert all(got[i]["n_links"] <= whole[i] <= want[i] for i in got)
