"""Fill-in-middle against a plain loop over code points, and exact round trips."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import frame
from statewise.llm import infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def _plain_loop(draws, text, moved_pct=90, spm_pct=20):
    h1, h2, h3, h4 = draws
    a = TOKEN.findall(text)
    lo, hi = sorted((h1 % (len(a) + 1), h2 % (len(a) + 1)))
    p, m, s = "".join(a[:lo]), "".join(a[lo:hi]), "".join(a[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= moved_pct:
        return len(a), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm_pct else f"<P>{p}<S>{s}<M>{m}"
    return len(a), "spm" if h4 % 100 < spm_pct else "psm", len(p), len(m), out


def _draws(i):
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    return [int(x[8 * j : 8 * j + 8], 16) for j in range(4)]


def test_documents_against_a_plain_loop(spark):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    made = infill.restore(infill.fill_in_middle(docs))
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert Counter(g[:-1] for g in got) == Counter((i, *_plain_loop(_draws(i), t or "")) for i, t in rows)
    assert Counter((g[0], g[-1]) for g in got) == Counter((i, t or "") for i, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.filter("doc_id < 0")).count() == 0


text = st.text(st.sampled_from(list("aZ<PSM> \n1é中\U0001f600")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(text, st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), max_size=8))
def test_any_slice_is_cut_as_by_the_loop_and_comes_back(rows):
    column = pa.array([t for t, _ in rows], pa.string())
    draws = np.array([d for _, d in rows], np.int64).reshape(-1, 4)
    made = infill.cut_texts(column, *draws.T, 90, 40)
    got = list(zip(*[c.to_pylist() for c in made.columns])) if rows else []
    assert got == [_plain_loop(d, t, 90, 40) for t, d in rows]
    form = np.searchsorted(infill.FORMS, np.array([g[1] for g in got], str))
    assert infill.rebuilt_texts(made.column("output"), form).to_pylist() == [t for t, _ in rows]


@pytest.mark.parametrize("share", [0, 100])
def test_shares_of_forms(spark, share):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('word ', id, ' more words') AS text")
    forms = Counter(r["form"] for r in infill.fill_in_middle(docs, moved_pct=100, spm_pct=share).collect())
    assert forms == {"spm" if share else "psm": 300}
