import random

import numpy as np
import pytest

from textloom.llm import near_duplicates as N
from textloom.llm.words import words


def brute(rows, fields, k, threshold):
    sets = {}
    for i, *ts in rows:
        ws = [w for t in ts for w in words(t)]
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("k, threshold", [(3, 0.5), (5, 0.8)])
def test_pairs_like_brute_force(spark, k, threshold):
    r = random.Random(3)
    vocabulary = [f"کلمه{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(60)] for _ in range(40)]
    rows = []
    for b in base:
        for e in (0, 0, 1, 2, 4, 8):
            w = list(b)
            for _ in range(e):
                w[r.randrange(60)] = r.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(w[:30]), " ".join(w[30:])))
    rows += [(901, None, None), (902, "", "یک"), (903, None, " ".join(base[0])), (904, "یک", None), (905, "یک", "دو"), (906, "", "!!")]
    df = spark.createDataFrame(rows, "row_id long, q string, a string").withColumnRenamed("q", "key")
    pairs, copies = N.similar_pairs(df, "row_id", ["key", "a"], k, threshold)
    got = [tuple(x) for x in N.all_pairs(pairs, copies).collect()]
    want = brute(rows, ["key", "a"], k, threshold)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want)
    groups = {g.id: (g.class_id, g.n_links) for g in N.duplicate_groups(df, "row_id", ["key", "a"], k, threshold).collect()}
    assert groups[1][0] == groups[2][0] == 1 and 901 not in groups


def test_all_copies_and_empty(spark):
    df = spark.createDataFrame([(i, "یک دو سه چهار پنج شش") for i in range(50)], "row_id long, t string")
    pairs, copies = N.similar_pairs(df, "row_id", ["t"], 3, 0.5)
    assert pairs.count() == 0 and copies.count() == 50
    assert N.all_pairs(pairs, copies).count() == 50 * 49 // 2
    pairs, copies = N.similar_pairs(df.limit(0), "row_id", ["t"], 3, 0.5)
    assert N.all_pairs(pairs, copies).count() == 0


def test_crowded_prefixes_grow(spark, monkeypatch):
    """Many records that share a template crowd the short prefixes: they go on with longer ones, and no link is lost."""
    monkeypatch.setattr(N, "MOST_COLLISIONS", 60)
    monkeypatch.setattr(N, "MOST_HASHES", 1700)
    r = random.Random(11)
    template = [f"قالب{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [f"خاص{r.randrange(10_000)}" for _ in range(46)]
        rows.append((len(rows), " ".join(template + own)))
        if i % 3 == 0:
            rows.append((len(rows), " ".join(template + own[:-3] + ["دیگر"])))
    df = spark.createDataFrame(rows, "row_id long, t string")
    levels = []
    labels = N._labels
    monkeypatch.setattr(N, "_labels", lambda depth, *x: levels.append(depth) or labels(depth, *x))
    pairs, copies = N.similar_pairs(df, "row_id", ["t"], 3, 0.5)
    got = {tuple(x) for x in N.all_pairs(pairs, copies).collect()}
    want = brute(rows, ["t"], 3, 0.5)
    assert max(levels) == N.longest(0.5) == 6 and got <= want and len(got) >= 0.98 * len(want) >= 49


def test_parameters():
    assert N.longest(0.5) == 7 and N.longest(0.8) >= 16
    a, b = N.signature(np.arange(1, 90, dtype=np.uint64) << np.uint64(40), 4, 20), N.signature(np.arange(1, 90, dtype=np.uint64) << np.uint64(40), 6, 30)
    assert (a.reshape(20, 4) == b.reshape(30, 6)[:20, :4]).all()
    assert N.trees_for(3, 0.5) == 32
    assert N.least_agreement(0.5) < 192


def test_groups_of_linked_records(spark):
    r = random.Random(7)
    words = [f"واژه{i}" for i in range(300)]
    base, other = r.sample(words, 60), r.sample(words, 60)
    changed = lambda ws, at: " ".join([*ws[:at], "دیگر", *ws[at + 1 :]])
    rows = [(1, " ".join(base)), (2, changed(base, 20)), (3, changed(base, 40)), (4, " ".join(base)), (5, " ".join(other)), (6, changed(other, 9))]
    rows += [(7, "بله، حتما."), (8, "بله حتما"), (9, "خیر"), (10, "!!!"), (11, "!!!"), (12, ""), (13, None)]
    found = {x.id: x for x in N.duplicate_groups(spark.createDataFrame(rows, "row_id long, t string"), "row_id", ["t"]).collect()}
    assert {i: x.group_id for i, x in found.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}
    assert {i: x.class_id for i, x in found.items()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10}


def test_components_like_union_find(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = N.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(root) and {x.id: x.group for x in got} == {x: top(x) for x in root}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0
