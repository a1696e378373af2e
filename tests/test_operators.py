import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import chunks, citations, consultations, evidence, graph, merge, sequences, vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_policies(spark):
    df = spark.createDataFrame([("a", 1, "x", None, ""), ("a", 2, "y", "p", None), ("a", 3, "z", None, "q"), ("b", 1, None, None, None), ("b", 2, None, None, "")], "id string, t int, l string, n string, e string")
    m = {r.id: r for r in merge.merge(df, ["id"], {"l": "last", "n": "last_non_null", "e": "last_non_empty"}, ["t"]).collect()}
    assert (m["a"].l, m["a"].n, m["a"].e) == ("z", "p", "q") and m["b"].e is None
    again = merge.merge_upsert(merge.merge(df, ["id"], {"l": "last", "n": "last_non_null", "e": "last_non_empty"}, ["t"]), df.where("t = 3").select("id", "l", "n", "e"), ["id"], {"l": "last", "n": "last_non_null", "e": "last_non_empty"}, ["l"])
    assert {r.id: r.e for r in again.collect()}["a"] == "q"
    with pytest.raises(ValueError):
        merge.merge(df, ["id"], {"l": "no such policy"}, ["t"])


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, None), (3, "c")], "k int, v string")
    assert rows(merge.overwrite(old, new.where("v IS NOT NULL"), "k", ["v"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(merge.insert_or_ignore(old, new.where("k = 3").withColumn("v", F.coalesce("v", F.lit("A"))), "k", ["v"])) == [(1, "a"), (2, None), (3, "A")]
    assert rows(merge.replace_group(old, new.where("k = 2"), "k")) == [(1, "a"), (2, "b")]
    assert rows(merge.check_unique(new, "k")) == [(3, 2)]
    nodes = spark.createDataFrame([("n:1", "note"), ("x", "index"), ("y", None)], "id string, type string")
    assert rows(merge.without_prefix(nodes, "id", "n:", "index")) == [("y", None)]
    with pytest.raises(Exception, match="no id"):
        merge.valid_lawyers(spark.createDataFrame([("", "u")], "lawyer_id string, profile_url string")).collect()


def test_labels(spark):
    df = spark.createDataFrame([("laws", "law_group"), ("unanimity", "decision"), ("laws", "zzz")], "d string, t string")
    got = [r[0] for r in df.select(merge.labels_of(F.col("d"), F.col("t"))).collect()]
    assert got == [["Law", "LawGroup", "Laws"], ["LegalDecision", "UnanimityDecision", "Unanimity"], None]


def test_expansion_like_trails(spark):
    r = random.Random(5)
    names = "abcdefg"
    edges = [(r.choice(names), r.choice(names), r.choice(["CONTAINS", "REFERENCES", "SECRET"]), str(i % 2)) for i in range(16)]
    df = spark.createDataFrame(edges, "source_id string, target_id string, relation_type string, raw_reference string")
    got = {(x.seed, x.neighbor): (x.hops, x.relation_types) for x in graph.expand(spark.createDataFrame([("a",), ("b",)], "id string"), df, 3).collect()}
    real = sorted({e for e in edges if e[2] != "SECRET"})
    want = {}
    for seed in "ab":
        paths = [(seed, [], [])]
        for hops in range(1, 4):
            nxt = []
            for at, used, kinds in paths:
                for i, (s, t, k, _) in enumerate(real):
                    if i not in used and at in (s, t):
                        nxt.append((t if at == s else s, [*used, i], [*kinds, k]))
            paths = nxt
            for at, _, kinds in paths:
                best = want.get((seed, at))
                if best is None or (hops, kinds) < best:
                    want[seed, at] = (hops, kinds)
    assert got == want


def test_expansion_parameters(spark):
    assert graph.seed_ids([" a", "a", "", "b "]) == ["a", "b"] and len(graph.seed_ids([str(i) for i in range(99)])) == 50
    assert graph.clamp(99, 3) == 3 and graph.clamp(0, 3) == 1
    neighbors = spark.createDataFrame([("s", f"n{i:03d}", 1 + i % 2, ["CONTAINS"]) for i in range(150)], "seed string, neighbor string, hops int, relation_types array<string>")
    nodes = spark.createDataFrame([(f"n{i:03d}", "" if i == 0 else "t") for i in range(150)], "id string, text string")
    got = graph.evidence(neighbors, nodes, 999).collect()
    assert len(got) == 99 and "n000" not in {x.neighbor for x in got}


def test_propagation(spark):
    nodes = spark.createDataFrame([("c", "category", "خانواده", None), ("g", "law_group", "g", None), ("d", "document", "d", None), ("e", "document", "e", "own"), ("z", "document", "z", None)], "id string, type string, title string, category string")
    edges = spark.createDataFrame([("c", "g"), ("g", "d"), ("g", "e"), ("d", "d")], "source_id string, target_id string").withColumn("relation_type", F.lit("CONTAINS"))
    assert dict(rows(graph.propagate(nodes, edges))) == {"c": None, "g": "خانواده", "d": "خانواده", "e": "own", "z": None}
    assert rows(graph.hierarchy(edges, nodes.where("id = 'c'").select("id"))) == [("c", "d", 2), ("c", "e", 2), ("c", "g", 1)]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    assert rows(graph.frontier(links, spark.createDataFrame([("a",)], "id string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_frontier_ends_where_nothing_is_new(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(18)] + [(18, 0), (3, None)], "a long, b long")
    seeds = spark.createDataFrame([(0,)], "id long")
    assert sorted(map(tuple, graph.frontier(links, seeds).collect())) == [(i, i) for i in range(19)]
    assert sorted(map(tuple, graph.frontier(links, seeds, 5).collect())) == [(i, i) for i in range(5)]


def test_identifiers(spark):
    df = spark.createDataFrame([("AMENDS",), ("bad name",)], "t string")
    assert df.where("t = 'AMENDS'").select(merge.checked_identifier(F.col("t")).alias("t")).first().t == "AMENDS"
    with pytest.raises(Exception, match="not an identifier"):
        df.select(merge.checked_identifier(F.col("t"))).collect()


def test_subword_chunks(spark):
    ranks, pattern = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", r" ?\p{L}+| ?\p{N}+|[^\s\p{L}\p{N}]+|\s+"
    coder = chunks._coder(ranks, pattern)
    body = "قانون مدنی و آیین نامه the civil code " * 30
    df = spark.createDataFrame([("a", body, "عنوان"), ("b", "", "x"), ("c", None, "x"), ("d", "کوتاه", None)], "id string, text string, title string")
    none = F.lit(None).cast("array<string>")
    got = chunks.subword_chunks(df, "id", "text", F.col("title"), none, 60, 10, ranks, pattern).orderBy("id", "chunk_index").collect()
    head = coder.encode_ordinary("عنوان: عنوان\n\n")
    own = [coder.encode_ordinary(r.text)[len(head) :] for r in got if r.id == "a"]
    assert all(r.token_count <= 60 for r in got) and {r.id for r in got} == {"a", "d"} and {r.chunk_count for r in got if r.id == "a"} == {len(own)}
    whole, joined = coder.encode_ordinary(body), []
    room = 60 - len(head)
    for i in range(len(own)):
        joined[i * (room - 10) :] = whole[i * (room - 10) : i * (room - 10) + room]
    assert joined == whole


def test_structure(spark):
    links = spark.createDataFrame([("i", "index", "c", "category"), ("c", "category", "d", "document"), ("d", "document", "d", "document")], "page string, page_type string, target string, target_type string")
    assert {(r.source_id, r.target_id, r.relation_type) for r in graph.structure(links).collect()} == {("i", "c", "LINKS_TO"), ("i", "c", "LISTS"), ("c", "d", "LINKS_TO"), ("c", "d", "CONTAINS")}
    chains = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, ["a"]), (3, [])], "k int, chain array<string>")
    assert rows(graph.breadcrumb_edges(chains, "k", "chain")) == [(1, 0, "a", "b"), (1, 2, "b", "c")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)], "k long, v array<double>")
    assert [(r.query, r.key, r.rank) for r in vectors.nearest(df, df.where("k = 1"), "k", "v", 3).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert vectors.nearest(df, df, "k", "v", 0).count() == 0 and vectors.nearest(df.limit(0), df.limit(0), "k", "v", 2).count() == 0
    with pytest.raises(Exception, match="places"):
        vectors.check_dimension(df.where("k = 5"), "v", 2).collect()


def test_hashing_embedding(spark):
    import hashlib
    import math
    import re

    text = "قانون مدنی Straße ماده ۱ ماده ۱"
    want = {}
    for t in re.findall(r"[^\W]+", text.casefold()):
        h = hashlib.sha256(t.encode()).digest()
        b = int.from_bytes(h[:8], "big") % 64
        want[b] = want.get(b, 0.0) + (1.0 if h[8] & 1 else -1.0)
    size = math.sqrt(sum(v * v for v in want.values()))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string")
    got = {r.bucket: r.value for r in vectors.hashing_embedding(df, "k", "t", 64).collect()}
    assert got == pytest.approx({b: v / size for b, v in want.items() if v})
    dense = vectors.dense(vectors.hashing_embedding(df, "k", "t", 64), "k", 64).first()
    assert len(dense.vector) == 64 and sum(v * v for v in dense.vector) == pytest.approx(1.0)


def test_responses(spark):
    import base64
    import struct

    good = base64.b64encode(struct.pack("<2f", 1.0, -2.0)).decode()
    schema = "custom_id string, response struct<status_code: int, body: struct<data: array<struct<embedding: string>>>>"
    data = [("a", (200, ([(good,)],))), ("b", (500, ([(good,)],))), ("c", (200, ([],))), ("d", (200, ([("!!",)],))), ("e", None)]
    ok, failed = vectors.split_responses(spark.createDataFrame(data, schema), 2)
    assert rows(ok) == [("a", [1.0, -2.0])] and dict(rows(failed)) == {"b": "status", "c": "items", "d": "dimension", "e": "status"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_windows(text, longest, overlap):
    out = chunks.windows(text, longest, overlap)
    assert all(0 < len(x) <= longest for x in out)
    assert set("".join(text.split())) == set("".join("".join(out).split()))


def test_token_chunks_like_a_loop(spark):
    data = [(str(n), " ".join(f"w{i}" for i in range(n)), "") for n in (0, 1, 7, 8, 9, 13, 14, 60)]
    df = spark.createDataFrame([(*d, ["Laws"]) for d in data], "id string, text string, title string, labels array<string>")
    got = {}
    for r in chunks.token_chunks(df, "id", "text", F.col("title"), F.col("labels"), 8, 3).orderBy("chunk_index").collect():
        got.setdefault(r.id, []).append(r.text)
    for name, text, _ in data:
        w, want, at = text.split(), [], 0
        while at < len(w):
            want.append(" ".join(w[at : at + 8]))
            if at + 8 >= len(w):
                break
            at += 5
        assert got.get(name, []) == want
    with pytest.raises(Exception, match="heading"):
        chunks.token_chunks(df.withColumn("title", F.lit("a b c d e f g h")), "id", "text", F.col("title"), F.col("labels"), 8, 3).collect()


def test_document_chunks(spark):
    df = spark.createDataFrame([("d1", "T", None), ("d2", "T2", "x " * 30)], "document_id string, title string, text string")
    got = chunks.document_chunks(df, 20, 2).orderBy("document_id", "chunk_index").collect()
    assert got[0].text == "T" and got[0].embedding_input == "T\n\nT" and all(r.chunk_count == len(got) - 1 for r in got[1:])


def test_shards_and_wave(spark):
    df = spark.range(45).select(F.col("id").alias("k"))
    got = rows(chunks.shards(df, ["k"], 20).select("k", "shard", "place", "custom_id"))
    assert len(got) == 45 and (0, 1, 1, "graph-0001-000001") in got and (44, 3, 5, "graph-0003-000005") in got
    w = chunks.wave(spark.createDataFrame([(1, 50), (2, 60), (3, 40), (4, 20)], "shard int, tokens int"), 100)
    assert [r.taken for r in w.orderBy("shard").collect()] == [True, False, True, False]


def test_evidence(spark):
    calls = spark.createDataFrame([("r", "same", 0.2, 1, "A", "t1", "secondary"), ("r", "same", 0.9, 2, "A", "t2", "primary"), ("r", "other", 0.5, 3, "B", "t3", "secondary"), ("r", "tie", 0.5, 4, "C", "t4", "secondary"), ("r", "tie", 0.5, 5, "C", "late", "secondary")],
                                  "run_id string, evidence_id string, score double, position int, title string, text string, authority string")
    ledger = evidence.ledger(calls)
    assert {(r.source_id, r.evidence_id, r.score, r.text) for r in ledger.collect()} == {("S1", "same", 0.9, "t2"), ("S2", "other", 0.5, "t3"), ("S3", "tie", 0.5, "t4")}
    schema = "run_id string, answer string, cited_source_ids array<string>, limitations array<string>"
    drafts = [("r", "این یک بند کامل از پاسخ است [S1] [S99].", [], None)]
    a = evidence.grounded(spark.createDataFrame(drafts, schema), ledger).first()
    assert a.cited == ["S1"] and "[S99]" not in a.answer and not a.limited and "- [S1] A" in a.answer
    b = evidence.grounded(spark.createDataFrame([("r", "پاسخی بدون هیچ منبع که بلند است", ["S77"], ["x"])], schema), ledger).first()
    assert b.limited and b.cited == [] and b.answer.startswith(evidence.INSUFFICIENT) and set(b.limitations) == {"x", evidence.INSUFFICIENT}
    c = evidence.grounded(spark.createDataFrame([("r", "بند نخست که بلند است [S2]\n\nبند دوم که ارجاع ندارد و بلند است", [], None)], schema), ledger).first()
    assert c.limitations == [evidence.UNCITED, evidence.NO_PRIMARY]
    d = evidence.grounded(spark.createDataFrame([("none", "متن", None, None)], schema), ledger).first()
    assert d.limited


def test_authority(spark):
    df = spark.createDataFrame([(["Law"], None), (["Law"], "reference_only"), (["Question", "Law"], None), ([], None), (None, None), (["Extra", "Law"], None)], "l array<string>, s string")
    got = [tuple(r) for r in df.select(evidence.authority(F.col("l"), F.col("s"), ("Extra",)), evidence.source_type(F.col("l"))).collect()]
    assert got == [("primary", "Law"), ("secondary", "Law"), ("auxiliary", "Law"), ("secondary", "legal_source"), ("secondary", "legal_source"), ("auxiliary", "Law")]


def test_guards(spark):
    assert evidence.guard(" a ") == "a"
    for bad in ("  ", "x" * 12_001):
        with pytest.raises(ValueError):
            evidence.guard(bad)
    m = spark.createDataFrame([("r", i) for i in range(5)], "k string, o int")
    assert rows(evidence.tail(m, "k", "o", 2)) == [("r", 3), ("r", 4)] and evidence.tail(m, "k", "o", 0).count() == 0


def test_articles_and_notes(spark):
    text = "مقدمه\nماده ۱ - متن یک. تبصره: الف\nماده (۲) متن دو\nتبصره ۳ - ب\nماده ۱ - تکرار"
    df = spark.createDataFrame([("document:show:1", text), ("document:show:2", None)], "id string, text string")
    found = citations.articles(df)
    got = {r.id: r.text for r in found.collect()}
    assert set(got) == {"article:document:show:1:ماده:1", "article:document:show:1:ماده:2"} and got["article:document:show:1:ماده:1"].endswith("تکرار")
    assert {r.id for r in citations.notes(found).collect()} == set()


def test_titles(spark):
    choices = spark.createDataFrame([("قانون مدنی", "d1"), ("قانون آیین دادرسی مدنی", "d2"), ("اساسنامه", "d3")], "title string, id string")
    phrases = spark.createDataFrame([("قانون مدنی",), ("طبق قانون آیین دادرسی مدنی جدید",), ("قانون دادرسی آیین مدنیی",), ("هیچ",), (None,), ("متن اساسنامه‌ها",)], "phrase string")
    got = {r.phrase: (r.id, r.confidence) for r in citations.resolve_titles(phrases, choices).collect()}
    assert got["قانون مدنی"] == ("d1", 1.0) and got["طبق قانون آیین دادرسی مدنی جدید"] == ("d2", 0.96) and got["متن اساسنامه‌ها"] == ("d3", 0.96)
    assert got["قانون دادرسی آیین مدنیی"][0] == "d2" and "هیچ" not in got
    assert citations.token_set_ratio("a b", "b a c") == 100.0 and citations.token_set_ratio("", "a") == 0.0
    assert citations.token_set_ratio("abcd", "abce") == pytest.approx(75.0)


@pytest.mark.parametrize("cutoff", [80.0, 82.0])
def test_similar_titles_like_brute_force(spark, cutoff):
    r = random.Random(11)
    stock = "قانون مجازات مدنی تجارت اسلامی آیین دادرسی کیفری ثبت اسناد املاک کار تامین اجتماعی مالیات مستقیم بیمه شهرداری صدور چک حمایت خانواده".split()
    titles = {" ".join(r.sample(stock, r.randrange(1, 6))) for _ in range(60)} | {"قانون مجازات"}
    titles = sorted(t for t in titles if len(t) >= 3)
    asked = {"قانون مجارات", "مجارات"}
    for t in titles * 4:
        letters = list(t)
        for _ in range(r.randrange(1, 4)):  # misspelt: changed, doubled, lost letters, and a suffix
            i = r.randrange(len(letters))
            letters[i : i + 1] = r.choice(["ژ", letters[i] * 2, "", letters[i] + "ی"])
        asked.add(" ".join("".join(letters).split()))
    asked = sorted(asked - {""} - set(titles))
    want = {}
    for c in asked:
        score, title = min((-citations.token_set_ratio(c, t), t) for t in titles)
        if -score >= cutoff:
            want[c] = (f"id {title}", round(-score / 100, 3))
    left = spark.createDataFrame([(c, c) for c in asked], "phrase string, c string")
    got = citations._similar(left, spark.createDataFrame([(t, f"id {t}") for t in titles], "title string, id string"), cutoff)
    assert {x.phrase: (x.id, x.confidence) for x in got.collect()} == want
    assert want["قانون مجارات"] == ("id قانون مجازات", 0.917)


def test_law_citations(spark):
    nodes = spark.createDataFrame([
        ("document:show:1", "document", "قانون مدنی", "ماده ۵ از قانون مدنی، لغو شد. بند ۷، مهم است", None), ("document:show:2", "document", "قانون کار", "طبق ماده ۹ از قانون ناشناخته دیگر، عمل شود", None),
        ("article:document:show:1:ماده:5", "article", "ماده 5", "ماده ۵، متن. ماده ۶، متن", "5"),
    ], "id string, type string, title string, text string, numeric_id string")
    edges = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    got = {(r.source_id, r.target_id, r.relation_type, r.confidence) for r in citations.law_citations(nodes, citations.title_choices(nodes), citations.article_lookup(nodes, edges)).collect()}
    assert ("document:show:1", "article:document:show:1:ماده:5", "REPEALS", 0.96) in got
    assert any(s == "document:show:1" and t == "document:show:1" and c == 0.72 for s, t, _, c in got)
    assert any(s == "document:show:2" and t.startswith("unresolved:") and c == 0.35 for s, t, _, c in got)
    assert any(s.startswith("article:") and t == "document:show:1" and c == 0.64 for s, t, _, c in got)


def test_ruling_citations(spark):
    nodes = spark.createDataFrame([("document:show:1", "document", "قانون مدنی", None, None, None), ("article:document:show:1:ماده:5", "article", "ماده 5", None, "5", None), ("dec:1", "decision", "r", "به موجب ماده ۵ قانون مدنی، مستند است. قانون ناشناس تازه، مطابق است. بند ۲، بی‌نام", None, "794")],
                                  "id string, type string, title string, text string, numeric_id string, decision_number string")
    edges = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    got = {(r.source_id, r.target_id, r.relation_type, r.confidence) for r in citations.ruling_citations(nodes, citations.title_choices(nodes), citations.article_lookup(nodes, edges)).collect()}
    assert ("dec:1", "article:document:show:1:ماده:5", "APPLIES", 0.96) in got and ("document:show:1", "article:document:show:1:ماده:5", "CONTAINS", 0.85) in got
    assert any(t.startswith("external_legal_document:") and c == 0.42 for _, t, _, c in got) and any(t.startswith("unresolved_legal_reference:") for _, t, _, _ in got)


def test_decision_citations(spark):
    data = [("a", "decision", "متن بلند است و رأی وحدت رویه شماره ۷۹۴، معارض است", "1"), ("b", "decision", None, "۷۹۴"), ("c", "decision", "رأی وحدت رویه شماره ۵، تایید شد و رأی وحدت رویه شماره ۹، هم", "2"), ("d", "decision", "", "5"), ("e", "decision", None, "5")]
    got = {(r.source_id, r.target_id[:9], r.relation_type, r.confidence) for r in citations.decision_citations(spark.createDataFrame(data, "id string, type string, text string, decision_number string")).collect()}
    assert ("a", "b", "DISTINGUISHES_DECISION", 0.95) in got and ("c", "external_", "AFFIRMS_DECISION", 0.6) in got and ("c", "external_", "AFFIRMS_DECISION", 0.4) in got


def test_consultation_graph(spark):
    lawyer = ("نام", "شهر", "u")
    data = [("7", "ok", "p", None, ("", "متن", [("برچسب", ""), ("برچسب", "url"), (" ", "")]), [(None, " ", None, None, lawyer), (None, "پاسخ", None, None, lawyer), (None, "دوم", None, None, None)]), ("8", "not_found", None, None, None, None), ("9", "ok", None, None, None, None)]
    nodes, links = consultations.graph(spark.createDataFrame(data, consultations.RECORD))
    ids = {r.id for r in nodes.collect()}
    assert {"question:7", "answer:7:2", "answer:7:3"} <= ids and "answer:7:1" not in ids and len(ids) == 5
    assert {r.url for r in nodes.where("label = 'Tag'").collect()} == {"url"}
    assert links.count() == 1 + 2 + 1
    with pytest.raises(Exception, match="request_id"):
        consultations.graph(spark.createDataFrame([(" ", "ok", None, None, ("t", "x", []), [])], consultations.RECORD))[0].collect()


def test_sequences(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(sequences.without_runs(F.col("x"))).collect()] == [["a", "b", "a"], []]
    pages = spark.createDataFrame([("l", i, n) for i, n in enumerate([3, 0, 2, 0, 0, 5, 0])], "l string, p int, n int")
    assert [r.p for r in sequences.until_empty(pages, "l", "p", "n", 2).orderBy("p").collect()] == [0, 1, 2, 3, 4]
    assert rows(sequences.unique_match(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "k string, v int"), "k", "v")) == [("a", 1)]


def test_hits_with_nested_payloads(spark):
    schema = "id string, score double, payload struct<entity_id:string, text:string, name:string, labels:array<string>, metadata:struct<entity_id:string, chunk_id:string, title:string, text:string, document_type:string, access_status:string, file_url:string>>"
    nested = ("m", "c", "عنوان", "متن دوم", "نوع", "reference_only", "u")
    data = [("1", 0.5, ("e", " متن ", "n", ["Article"], None)), ("2", 0.4, ("", "", None, ["Article"], nested)), (" ", 0.3, ("e", "t", None, None, None)), ("4", 0.2, (None, "t", None, None, (None, "c4", *[None] * 5))), ("5", 0.1, (None, "t", None, None, None))]
    got = {r.evidence_id: r for r in evidence.from_hits(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {"vector:1", "vector:2", "vector:4"}
    one, two, four = got["vector:1"], got["vector:2"], got["vector:4"]
    assert (one.entity_id, one.title, one.text, one.authority, one.source_type) == ("e", "n", "متن", "primary", "Article")
    assert (two.entity_id, two.title, two.text, two.source_type, two.authority, two.source_uri) == ("m", "عنوان", "متن دوم", "نوع", "secondary", "u")
    assert (four.entity_id, four.title, four.source_type) == ("c4", "c4", "legal_source")


def test_budgets(spark):
    calls = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "c")], "run_id string, call int, evidence_id string")
    assert [r.evidence_id for r in evidence.within_calls(calls, 2).collect()] == ["a", "b"]
    lists = [spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, rank int"), spark.createDataFrame([("c", 1), ("a", 2)], "k string, rank int")]
    assert {r.k: round(r.score, 6) for r in evidence.fused(lists, "k", 60, 1).collect()} == {"a": round(1 / 61, 6), "c": round(1 / 61, 6)}


def test_stages_are_discarded(spark):
    from pathlib import Path

    from textloom import session

    session.written(spark.range(3), "x").count()
    folder = Path(session._stages(spark).removeprefix("file://").removeprefix("file:"))
    assert any(folder.iterdir())
    session.discard_stages(spark)
    assert not folder.exists()
