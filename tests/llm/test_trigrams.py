"""Trigram queries: none of a rule's matches is missed, rows without its trigrams are set aside, and the further kinds are found."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from statewise.llm import secret_scan
from statewise.llm.secret_scan import BASE_RULES, EXTRA_RULES, Segment, _literals, _trigrams, marked, trigram_query

GITHUB, JWT = "ghs_" + "aB3" * 12, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"


def _found(pattern, texts):
    query = trigram_query(pattern)
    wanted = np.array(sorted({t for s in _literals(query) for t in _trigrams(s)}), np.int64)
    return set(Segment(pa.array(texts, pa.string()), wanted, marked(wanted)).find(query).tolist())


def test_queries_of_known_patterns():
    assert trigram_query("AKIA[A-Z0-9]+") == ("lit", "akia")
    assert trigram_query("[0-9a-f]+") == ("all",)
    assert trigram_query("(abc)?") == ("all",) and trigram_query("abc|d") == ("all",) and trigram_query("(abcd)*x") == ("all",)
    assert trigram_query("abc|wxyz") == ("or", [("lit", "abc"), ("lit", "wxyz")])
    assert trigram_query("abc[0-9]+(xyz|uvw)") == ("and", [("lit", "abc"), ("or", [("lit", "xyz"), ("lit", "uvw")])])
    assert sorted(_literals(trigram_query(EXTRA_RULES[1].pattern))) == [f"gh{c}_" for c in "oprsu"]
    assert {"private key-----", "-----begin "} <= set(_literals(trigram_query(EXTRA_RULES[0].pattern)))


@pytest.mark.parametrize("pattern", [r.pattern for r in BASE_RULES + EXTRA_RULES] + ["ab?cde", "(ab|cd){2}ef", "x(abc)+y", "[ab]cd[ef]", "(?:abc|de)fg", "a.cdef", "abc(?=d)", "é+abc"])
def test_no_match_is_missed(pattern):
    rng = random.Random(pattern)
    pieces = ["password", "toKen", "api_key", "apikey", ":", "=", " ", "'", "AKIA", "ABCDEF0123", "0af9", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "PRIVATE KEY", "ghp_", GITHUB, "gh", "eyJ", JWT, "."]
    pieces += ["xabc", "abcy", "ab", "a", "bcde", "cde", "cd", "ef", "abc", "x", "y", "f", "de", "fg", "é", "", "d"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(3000)] + [None, "", "ab"]
    rule = next((r for r in BASE_RULES + EXTRA_RULES if r.pattern == pattern), None)
    compiled = rule.compiled() if rule else re.compile(pattern)
    matching = {i for i, t in enumerate(texts) if t and compiled.search(t)}
    found = _found(pattern, texts)
    assert matching and matching <= found
    if trigram_query(pattern) != ("all",):
        assert len(found) < len(texts)


def test_further_kinds(spark):
    data = [
        (1, f"é {GITHUB}."), (2, "ghs_" + "z" * 35), (3, f"x {JWT} y"), (4, "eyJabc.eyJabc.abc"), (5, "-----BEGIN EC PRIVATE KEY-----"),
        (6, "-----begin ec private key-----"), (7, f"token={GITHUB}"), (8, "ghs _" + "a" * 40), (9, f"{JWT}\n{JWT}"),
    ]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    n = len(JWT)
    assert got == {
        1: "github:2:42", 2: "", 3: f"jwt:2:{2 + n}", 4: "", 5: "private:0:30", 6: "",
        7: "assign:0:46,github:6:46", 8: "hex:5:45", 9: f"jwt:0:{n},jwt:{n + 1}:{2 * n + 1}",
    }
