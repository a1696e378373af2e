"""F1 of round 2: p9_found does the same work for less."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import xxhash

from textloom.llm import confusables, words
from textloom.llm import subjects as S

TOKEN = re.compile(r"[^\W_]+|[.؟!?؛;\r\n]")


def by_pattern(texts):
    """(hash of each word, 0 for each end of a sentence; tokens up to the end of each text), one token after another."""
    h, ends = [], []
    for t in texts:
        for x in [*TOKEN.findall(t), "\n"]:
            h.append((xxhash.xxh3_64_intdigest(words.word(x)) & ~1 | (x < "ɐ")) or 2 if x[0].isalnum() else 0)
        ends.append(len(h))
    return h, ends


def odd_texts(r, n):
    kinds = ["aB_۱1 .؟\n\r‌یكé", "𝒜𐎀\U00010400ß _.", "x", "۱۲۳٣²½Ⅷ -", ".!\n"]
    return ["".join(r.choices(r.choice(kinds), k=r.randrange(60))) for _ in range(n)] + ["", "x" * 5000 + "_" + "x" * 4999, "İstanbul ISTANBUL"]


def test_tokens_are_those_of_the_pattern(monkeypatch):
    r = random.Random(2)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = odd_texts(r, 800) + ["".join(points[at : at + 5000]) for at in range(0, len(points), 5000)]
    monkeypatch.setattr(S, "_KEPT_BITS", 4)  # sixteen places: words push each other out
    monkeypatch.setattr(S, "_kept_keys", np.zeros(16, np.uint64))
    monkeypatch.setattr(S, "_kept_hashes", np.zeros(16, np.uint64))
    for _ in range(2):
        h, ends = S._tokens(texts)
        assert (h.tolist(), ends.tolist()) == by_pattern(texts)


def test_features_do_not_depend_on_what_is_divided_together(monkeypatch):
    texts = [None, "", *odd_texts(random.Random(3), 200), None]
    whole = S.features(texts)
    for together in (0, 100, 4000):
        monkeypatch.setattr(S, "TOGETHER", together)
        assert all(np.array_equal(a, b) for a, b in zip(whole, S.features(texts)))
    assert len(whole[2]) == len(texts) and [len(x) for x in S.features([])] == [0, 0, 0]


def test_ordinary_characters_are_the_same():
    known = set(confusables._ORDINARY + "‌")
    for c in map(chr, range(0x3000)):
        assert bool(confusables._is_ordinary(c)) == (c in known) == bool(confusables._is_ordinary("a" + c + "b"))
    assert confusables._is_ordinary("") is not None and not confusables._is_ordinary("a\n\x00")


def test_frequencies_count_documents():
    r = np.random.default_rng(1)
    own = [r.integers(0, 300, k).astype(np.uint16) for k in r.integers(1, 400, 1203)] + [np.array([65535, 65535, 0], np.uint16)]
    out = list(S._frequencies(iter([pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary())], names=["f"])])))
    found = dict(zip(out[0].column(0).to_pylist(), out[0].column(1).to_pylist()))
    whole = {-1: len(own)} | {b: n for b in range(S.BUCKETS) if (n := sum(b in x for x in own) if b in (0, 7, 65535) else 0)}
    assert all(found[b] == n for b, n in whole.items()) and sum(found.values()) == len(own) + sum(len(set(x.tolist())) for x in own)


def test_counts_times_shares_are_the_shares_added_one_by_one(spark):
    r = np.random.default_rng(4)
    cells, shares = r.integers(0, [9000, 5], (4000, 2)), r.random((5, 3))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in cells], "f int, leaf int").repartition(3)

    def add(counts, p):
        np.add.at(counts, (p.column("f").to_numpy(), p.column("leaf").to_numpy()), 1)

    whole = np.zeros((9000, 3))
    np.add.at(whole, cells[:, 0], shares[cells[:, 1]])
    assert np.allclose(S._added(rows, add, (9000, 3), shares), whole, atol=1e-5)


def test_reading_texts_costs_less_than_a_pattern_and_a_set():
    r = random.Random(5)
    letters = "ابپتجخدرسشعفقکگلمنوهی"
    known = ["".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(known, k=180)) + "." for _ in range(1000)]
    ordinary = frozenset(confusables._ORDINARY + "‌").issuperset

    def least(f):
        took = []
        for _ in range(4):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    new = least(lambda: [S.features(texts[at : at + 500]) for at in (0, 500)])
    assert new < least(lambda: [(ordinary(t), TOKEN.findall(t)) for t in texts])
