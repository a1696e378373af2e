import random

import numpy as np

from textloom.llm import subjects as S
from textloom.session import written

TERMS = {"sport": "مدال دوپینگ باشگاه ورزشگاه داور".split(), "tax": "مالیات اظهارنامه مودی گمرک بخشودگی".split(), "family": "طلاق مهریه نفقه حضانت جهیزیه".split()}
FRAMES = ["در رأی شماره {} دادگاه، {} همان {} به شمار نیامد.", "فصل {} به {} اختصاص دارد و {} را استثنا می‌کند.", "بررسی {} نشان داد که {} و {} از هم جداست."]
NONE = ["فهرست پیوست‌ها در پایان صفحه می‌آید.", "شماره صفحات پس از ویرایش تغییر کرده است.", "تاریخ نگارش در سربرگ آمده است.", "نسخه چاپی با نسخه برخط تفاوت دارد."]


def sentence(r, subject):
    return r.choice(FRAMES).format(r.randrange(400), r.choice(TERMS[subject]), r.choice(TERMS[subject]))


def test_areas(spark):
    r = random.Random(4)
    docs, truth = [], {}
    for i in range(400):
        mix = r.sample(list(TERMS), 1 if i % 5 else 2)
        docs.append((i, " ".join(sentence(r, s) for s in mix for _ in range(4))))
        truth[i] = set(mix)
    docs += [(i, " ".join(r.choices(NONE, k=6))) for i in range(500, 530)]
    docs += [(900, " ".join(NONE)), (901, None), (902, ""), (903, docs[1][1])]
    truth[903] = truth[1]
    labels = [(i, s) for i in range(0, 400, 4) for s in truth[i]] + [(4, "tax"), (8, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")  # noqa: E741
    records = S.described(d, "doc_id", "text").cache()
    found: dict = {}
    for x in S.areas(records, S.learn(records, l)).collect():
        found.setdefault(x.doc_id, set()).add(x.subject)
        assert 0.2 <= x.share <= 1.0001
    held = [i for i in truth if i % 4]
    assert sum(found.get(i, set()) == truth[i] for i in held) >= 0.9 * len(held)
    assert found[903] == found[1] and 901 not in found and 902 not in found and 900 not in found
    assert S.areas(records, S.learn(records, l.limit(0))).count() == 0
    none = S.described(d.limit(0), "doc_id", "text")
    assert S.areas(none, S.learn(none, l)).count() == 0


def test_features():
    f, sizes, per_text = S.features(["یک دو. سه", None, "", "چهار"])
    assert sizes.tolist() == [3, 1, 1] and per_text.tolist() == [2, 0, 0, 1] and len(f) == 5


def test_every_document_counts_however_many_have_labels(spark):
    """More labelled documents than the sample holds: unlabelled ones are still clustered, and text on none is learnt."""
    r = random.Random(5)
    docs = [(i, " ".join(sentence(r, "tax" if i % 2 else "sport") for _ in range(4))) for i in range(300)]
    docs += [(i, " ".join(r.choices(NONE, k=6))) for i in range(300, 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([(i, "tax" if i % 2 else "sport") for i in range(200)], "doc_id long, subject string")  # noqa: E741
    records = S.described(d, "doc_id", "text").cache()
    model = S.learn(records, l, sample=100)
    f, sizes, _ = S.features(NONE)
    learnt = S._by_sentence(model.weights, f, sizes.cumsum() - sizes)
    assert (learnt.argmax(axis=1) == len(model.subjects)).all() and (learnt[:, -1] > 0).all()
    df, n = S.document_frequencies(records)
    marked = l.selectExpr("doc_id AS k", "array(subject) AS subjects")
    assigned = S.in_leaves(records, marked, *S.cluster(records, df, n, 100))
    assert assigned.count() == 400 and assigned.where("subjects IS NULL").count() == 200


def bisected_in_memory(x, most):
    """Sums of the leaves, by the letter: the leaf with the largest scatter is split next."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    plane = lambda a, b: np.rint((unit(a) - unit(b)) * (S.NORM / 2))
    farthest = lambda own, v: min(own[own @ v == (own @ v).min()], key=lambda r: r.astype(np.int16).tobytes())
    scatter = lambda own: len(own) - np.linalg.norm(own.sum(axis=0)) / S.NORM if len(own) >= 2 * S.LEAST_LEAF else 0.0
    x = x.astype(float)
    found, scatters = [x], [scatter(x)]
    while len(found) < most and max(scatters) > 0:
        i = int(np.argmax(scatters))
        own, side = found[i], None
        a = farthest(own, np.rint(unit(own.sum(axis=0)) * S.NORM))
        b = farthest(own, a)
        for _ in range(S.STEPS):
            new = own @ plane(a, b) >= 0
            if new.all() or not new.any() or (side is not None and (new == side).all()):
                side = new
                break
            side = new
            a, b = own[side].sum(axis=0), own[~side].sum(axis=0)
        if side.any() and not side.all():
            found[i : i + 1], scatters[i : i + 1] = [own[side], own[~side]], [scatter(own[side]), scatter(own[~side])]
        else:
            scatters[i] = 0.0
    return sorted(own.sum(axis=0).astype(int).tolist() for own in found)


def test_bisection_takes_every_row_however_the_nodes_are_held(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(30, S.DIMS))[r.integers(0, 30, 1500)] + r.normal(size=(1500, S.DIMS)) * r.uniform(0.2, 1.5, (1500, 1))
    x[100:160] = x[100]
    x[200] = 0
    x = np.rint(S._unit(x) * S.NORM).astype(np.int16)
    rows = written(spark.createDataFrame(S.packed(x).to_pylist(), "n int, x binary").repartition(3), "vectors")
    monkeypatch.setattr(S, "LEAVES", 24)
    whole = bisected_in_memory(x, S.LEAVES)
    assert len(whole) == S.LEAVES
    for held, most in (150, 0), (400, S.DIRECT), (5000, S.DIRECT):
        nodes = S.bisection(rows, held, most)
        assert sum(node.n for node in nodes) == 1500
        assert sorted(node.total.tolist() for node in nodes) == whole


def test_centres_come_from_all_documents(spark):
    """A tenth of the documents would miss the rare subjects; the centres don't depend on any number of documents."""
    r = random.Random(6)
    docs = [(i, " ".join(sentence(r, "tax" if i % 20 else "family") for _ in range(3))) for i in range(600)]
    records = S.described(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").cache()
    df, n = S.document_frequencies(records)
    few, all_ = (S.cluster(records, df, n, k)[1] for k in (60, 10_000))
    assert few.shape == all_.shape and np.allclose(few, all_, atol=1e-5)
