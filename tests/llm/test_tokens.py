"""Each distinct pre-token is counted once, frequent ones are bounded, unknown splitting rules are errors."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from statewise.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_every_pre_token_is_counted_once(spark):
    definition = _definition()
    rows = [(i, f"the cat and w{i % 7} the dog\n{'-' * 200} <|endoftext|>") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    count = token_counts.counter_of(definition)
    for known in ({}, {" cat": 1, "the": 1}, token_counts.named_pieces(definition)):
        want: dict[str, int] = {}
        for _, text in rows:
            for token, n in count(text)[0].items():
                if token not in known:
                    want[token] = want.get(token, 0) + n
        for held in (3, 100_000):
            found = token_counts.dictionary_of(docs, definition, spark.sparkContext.broadcast(known), held).collect()
            assert sorted((r["token"], r["n"]) for r in found) == sorted(want.items())


def test_named_pieces_are_the_librarys_counts():
    from tokenizers import Tokenizer

    tokenizer, named = Tokenizer.from_file(PATH), token_counts.named_pieces(_definition())
    assert 40_000 < len(named) <= tokenizer.get_vocab_size() and "<|endoftext|>" not in named
    assert all(len(tokenizer.encode(t, add_special_tokens=False)) == named[t] for t in list(named)[::500])


def test_frequent_pre_tokens_are_bounded(spark):
    docs = spark.createDataFrame([(i, "a " * 50 + f"x{i} y{i * i}") for i in range(200)], "doc_id long, text string")
    table = token_counts.dictionary_of(docs, _definition(), spark.sparkContext.broadcast({}))
    total, most = table.agg(F.sum("n")).first()[0], 0
    for bound in (10, 100, 1000, 10_000):
        hot = table.filter(token_counts.is_frequent(total, bound))
        size = hot.agg(F.sum(F.octet_length("token") + token_counts.ENTRY)).first()[0] or 0
        assert most <= size <= bound
        most = size
    assert most > 0


def test_other_rules_are_errors(spark):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError):
            token_counts.splitting(json.dumps(spec | change))
    assert token_counts.splitting(json.dumps(spec | {"added_tokens": []}))[1] == []


def test_columns_named_like_the_operators_own(spark):
    rows = [(1, "two words", 5, "x"), (None, None, None, None), (1, "two words", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, tokens string").withColumns({"id": F.lit(3), "hot": F.lit(1), "token": F.lit("t"), "__id": F.lit(0)})
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH).collect())
    assert got == [(0, 0, 0), (1, 9, 2), (1, 9, 2)]
