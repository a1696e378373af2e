import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import leakage as L
from textloom.llm.words import words


def test_like_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"واژه{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(12)] + [(90, "کوتاه"), (91, None), (92, "واژه‌ای کوتاه")]
    docs = []
    for i in range(200):
        w = [r.choice(vocabulary) for _ in range(80)]
        if i % 4 == 0:
            src = items[r.randrange(12)][1].split()
            n, at = r.randrange(8, 30), r.randrange(10)
            w[20:20] = src[at : at + n]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, items[0][1].replace("واژه", "واژه")), (903, items[0][1].replace(" ", "  "))]
    docs += [(904, "متن کوتاه، واژه ای کوتاه"), (905, "کوتاه")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: {tuple(w[j : j + 12]) for w in [words(t)] for j in range(len(w) - 11)}
    want = {(i, j) for i, t in docs for j, u in items if grams(t) & grams(u)}
    every = L.leaks(d, e).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in every if r.item_id >= 90} == {(904, 90, 1), (905, 90, 1), (904, 92, 3)}
    got = [r for r in every if r.item_id < 90]
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.n_words >= 12 for r in got) and {r.n_words for r in got if r.doc_id in (902, 903)} == {40}
    assert L.leaks(d, e.limit(0)).count() == 0 and L.leaks(d.limit(0), e).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 9), min_size=12, max_size=20))
def test_shared_span_shares_a_fingerprint(a, b, span):
    x, y = np.array(a + span, np.uint64), np.array(span + b, np.uint64)
    assert set(L.fingerprints(x, 12).tolist()) & set(L.fingerprints(y, 12).tolist())
    assert L.longest_run(x, y, 12)[0] >= len(span)
