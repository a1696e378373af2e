"""Nulls, very long texts, clashing column names, for every operator."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import confusables, leakage, near_duplicates, packing, pairs, personal, pieces, residue, subjects

LONG = ["خیابان الف، " * 20_000, "a.b-c" * 40_000, "۱۲۳ " * 50_000, "صفر نه " * 30_000, "\n" * 100_000, "{{" * 50_000, "%الف " * 40_000, "قانون مدنی است. " * 20_000, "x" * 300_000, "‌​" * 50_000, "آقای " * 40_000, "(at) " * 30_000]
SCHEMA = "id long, k string, t string, s string, a string, b string, value string, n string, host string, url string, text string, row_id long"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, *["c"] * 8, "https://h.example/", text, i) for i, text in enumerate(LONG)]
    data += [(None, *[None] * 8, None, None, 100), (None, *["c"] * 8, "not a url", "", 101), (2, *["c"] * 8, None, "متن کوتاه", None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_personal(rows):
    lexicon = personal.learn(rows.select("text"), rows.select("k"))
    for text in LONG:
        began = time.time()
        personal.items(text, lexicon.prefilter())
        assert time.time() - began < 20, text[:10]
    assert personal.found_items(rows, "row_id", "text", lexicon).count() >= 0


def test_near_duplicates(rows):
    linked, copies = near_duplicates.similar_pairs(rows, "row_id", ["text", "a"], 3, 0.5)
    assert near_duplicates.all_pairs(linked, copies).count() >= 0


def test_pairs(rows):
    found = {r.row_id: r.defect for r in pairs.broken_pairs(rows, "row_id", "a", "text").collect()}
    assert found[100] == "empty" and found[101] == "empty"


def test_residue(rows):
    found = {r.row_id: r.reason for r in residue.residue_texts(rows, "row_id", "text", "url").collect()}
    assert 100 not in found and residue.bad_statuses(rows, "row_id", "host", ("c",)).count() == 0


def test_pieces(rows):
    cut = pieces.split_texts(rows, "row_id", "text", 4000, 300)
    assert cut.where(F.length("piece") > 4000).count() == 0 and cut.select("row_id").distinct().count() == len(LONG) + 1


def test_confusables(rows):
    assert confusables.inconsistent_values(rows, "row_id", ["text", "value"], "x").count() >= 1
    assert confusables.look_alike_groups(rows, "row_id", "text").count() == len(LONG) + 1  # invisible characters alone look like an empty text


def test_packing(rows):
    sizes = packing.token_counts(rows, "row_id", "k")
    assert packing.pack(sizes, "row_id", "n_tokens", 8192).count() == len(LONG) + 3


def test_leakage(rows, spark):
    items = spark.createDataFrame([(1, "قانون مدنی است " * 5), (None, "x")], "item_id long, text string")
    assert {r.item_id for r in leakage.leaks(rows, items, "row_id").collect()} == {1}


def test_subjects(rows, spark):
    labels = spark.createDataFrame([(7, "law"), (None, "law"), (999, "tax")], "row_id long, subject string")
    records = subjects.described(rows, "row_id", "text")
    assert subjects.areas(records, subjects.learn(records, labels, "row_id"), "row_id").count() >= 0
