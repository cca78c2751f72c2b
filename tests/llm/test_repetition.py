import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import repetition as R


def plain(text, window):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    hit = [0] * len(w)
    for i in range(len(w) - window + 1):
        if seen[tuple(w[i : i + window])] > 1:
            hit[i : i + window] = [1] * window
    longest = 0
    for n in range(1, len(w)):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        if max(c.values(), default=0) < 2:
            break
        longest = n
    return len(w), sum(hit), longest


texts = st.lists(st.sampled_from(["a", "b", "c", "dd", "e\n", "f"]), max_size=60).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_against_windows(batch):
    got = R.measure(batch)
    for i, t in enumerate(batch):
        n, repeated, longest = plain(t, R.WINDOW)
        assert (got["n_words"][i], got["n_repeat_words"][i]) == (n, repeated)
        assert got["n_covered"][i] == plain(t, R.MIN_REPEAT)[1]
        assert got["longest_repeat"][i] == (longest if longest >= R.MIN_REPEAT else 0)


def test_long_runs():
    n = 20_000
    got = R.measure([" ".join(["w"] * n), " ".join(str(i) for i in range(n))])
    assert got["longest_repeat"] == [n - 1, 0] and got["n_repeat_words"] == [n, 0]


def test_spans_stay_within_texts():
    rank, doc = R.dense_ranks([[b"a"] * 6, [b"a"] * 6])
    assert R.deepest_repeats(rank, doc, 5).tolist() == [5, 5, 0, 0, 0, 0] * 2
    assert R.covered(np.array([5, 5, 0, 0, 0, 0]), 5).all()


def test_documents(docs, empty):
    rows = {(r.doc_id, r.n_words): r for r in R.quality(docs).collect()}
    assert len(rows) <= 11 and R.quality(docs).count() == 11
    assert rows[5, 0].base_failed and rows[4, 0].n_symbols == 0 and not rows[9, 12000].kept
    assert rows[1, 23].kept and not rows[1, 23].base_failed
    assert R.quality(empty).count() == 0
