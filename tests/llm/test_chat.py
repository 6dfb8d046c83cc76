"""Preference pairs with ids that are missing or are not numbers."""

import random

import pytest

from statewise.llm import chat_format


def _plain(c, r):
    """The pair by the definition, over whole lists of turns."""
    render = lambda ts: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in ts)
    n = next((i for i, (x, y) in enumerate(zip(c, r)) if x != y), min(len(c), len(r)))

    def mask(ts):
        out, at = [], 0
        for role, text in ts:
            start = at + len(role) + 5
            out += [f"{start}:{start + len(text) + 7}"] * (role == "assistant")
            at = start + len(text) + 8
        return ",".join(out)

    return n, len(c) - n, len(r) - n, render(c[:n]), render(c[n:]), render(r[n:]), mask(c[n:]), mask(r[n:])


@pytest.fixture
def small_parts(spark):
    """Parts of few rows, which Spark would otherwise join."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_a_conversation_over_many_parts_equals_the_definition(spark, small_parts):
    rng = random.Random(3)
    turn = lambda: (rng.choice(["user", "assistant"]), "é" * rng.randrange(4) + rng.choice("ab"))
    sides = {}
    for pair, n in ((None, 900), (1, 700), (2, 3), (3, 0), (4, 5)):  # two of them hold nearly all rows
        c = [turn() for _ in range(n)]
        at = {None: 640, 1: 700, 2: 0, 3: 0, 4: 5}[pair]
        sides[pair] = c, c[:at] + [turn() for _ in range(rng.randrange(1, 300))]
    table = lambda k: spark.createDataFrame([(p, i, *t) for p, s in sides.items() for i, t in enumerate(s[k])], "pair_id long, turn long, role string, text string").repartition(5)
    chosen, rejected = table(0), table(1)
    turns, heads = chat_format._numbered(chosen, rejected)
    assert heads.filter("pair.pair_id is null").select("part").distinct().count() > 1  # cut, not one task
    got = {r["pair_id"]: tuple(r)[1:] for r in chat_format.format_preferences(chosen, rejected).collect()}
    assert got == {p: _plain(*s) for p, s in sides.items()}
    assert chat_format.preference_turns(chosen, rejected).count() == sum(sum(_plain(*s)[:3]) for s in sides.values())


def test_a_missing_id_is_one_pair(spark):
    s = "pair_id string, turn long, role string, text string"
    chosen = spark.createDataFrame([(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), ("x", 0, "user", "q")], s)
    rejected = spark.createDataFrame([(None, 0, "user", "hi"), (None, 1, "assistant", "no"), ("y", 0, "user", "q")], s)
    got = {r["pair_id"]: r for r in chat_format.format_preferences(chosen, rejected).collect()}
    assert set(got) == {None, "x", "y"} and got[None]["n_common"] == 1 and got[None]["chosen"].endswith("yes<|end|>\n") and got[None]["rejected"].endswith("no<|end|>\n")
    assert got["x"]["rejected"] == "" and got["y"]["chosen"] == "" and got["y"]["rejected"] != ""


def test_ids_that_are_not_numbers(spark):
    rows = [("7", 0, "user", "a"), ("7", 1, "assistant", "b"), ("8", 0, "user", "c"), ("8", 1, "assistant", "d"), ("k", 0, "user", "e"), ("k", 1, "assistant", "f"), (None, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").selectExpr("*", "1 as pair_id", "2 as number", "3 as other", "4 as last")
    got = {r["pair_id"]: r for r in chat_format.format_preferences(*chat_format.reply_pairs(df)).collect()}
    assert set(got) == {"7", "8", "k", None}
    assert got["7"]["rejected"] == "<|assistant|>\nd<|end|>\n" and got["7"]["prompt"] == got["7"]["prompt"].strip() + "\n"
    assert got["8"]["rejected"] == "" and got["k"]["rejected"] == "" and got["k"]["chosen"] == "<|assistant|>\nf<|end|>\n"
    assert got[None]["chosen"] == "<|assistant|>\n<|end|>\n"
