"""Registered corpus queries against DuckDB, and the pipeline against its stages by brute force."""

import pytest

from compare import connect, same
from statewise.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, name):
    same(llm.queries()[name](spark, SF), connect(SF), llm.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    con = connect(SF)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({llm.oracle_sql()['op6_quality_rules']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in out["quality_rules"]} == kept
    con.execute("CREATE TABLE kept AS SELECT * FROM documents WHERE doc_id IN (" + ",".join(map(str, kept)) + ")")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM kept")
    first = {r[0] for r in con.sql(f"SELECT doc_id FROM ({llm.oracle_sql()['op2_jaccard_join']}) WHERE doc_id = class_id").fetchall()}
    assert {r["doc_id"] for r in out["jaccard_join"]} == first
    leaked = {r[0] for r in con.sql(f"SELECT doc_id FROM ({llm.oracle_sql()['op7_decontamination']})").fetchall()}
    assert {r["doc_id"] for r in out["decontamination"]} == first - leaked
    copies = [r["doc_id"] for r in out["mixing"]]
    assert set(copies) <= first - leaked and max(map(copies.count, copies)) <= 3
    assert sorted(r["doc_id"] for r in out["sharding"]) == sorted(copies)
