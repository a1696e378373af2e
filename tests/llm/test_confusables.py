from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import confusables as C

LETTERS = st.text(alphabet="ابپیکهآئ يىكةۀەہھٔٓ‌​‍­ aAеаοΙ　９٣۳é́.\n\t،", max_size=30)


def test_cases():
    assert C.consistent("كتاب يك") == "کتاب یک"
    assert C.consistent("مي‌‌گويد") == "می‌گوید"
    assert C.consistent("a‌b ‌ج") == "ab ج"
    assert C.consistent("ﺍﯾﻠﺘﺒﺎﺭ") == "ایلتبار"
    assert C.consistent("Ｅｘｃｅｌ　９") == "Excel 9"
    assert C.consistent("٣٤") == "۳۴"
    assert C.consistent("еxample KАVEH") == "example KAVEH"
    assert C.consistent("Договор Σ") == "Договор Σ"
    assert C.consistent("هیئت") == "هیئت"
    assert C.consistent("résumé") == "résumé"
    assert C.consistent("فرّخ عمداً\r\n") == "فرّخ عمداً\r\n"
    assert C.consistent(None) is None and C.consistent("") == ""


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_idempotent(s):
    c = C.consistent(s)
    assert C.consistent(c) == c
    assert C.skeleton(C.skeleton(s)) == C.skeleton(s)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_consistent_keeps_look(s):
    assert C.skeleton(C.consistent(s)) == C.skeleton(s)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_pattern_lets_no_change_pass(s):
    import re

    assert (re.search(C.SUSPECT, s) is None) == C._ordinary(s)
    if C._ordinary(s):
        assert C.consistent(s) == s


def test_values(spark):
    rows = [(1, "كتاب", "x"), (2, "کتاب", "y"), (3, None, "z"), (4, "", None), (5, "كتاب", "x"), (6, "می‌گوید " * 5000, "long")]
    df = spark.createDataFrame(rows, "row_id long, name string, value string")
    found = C.inconsistent_values(df, "row_id", ["name"], "t")
    assert sorted(r.row_id for r in found.collect()) == [1, 5]
    groups = C.look_alike_groups(df, "row_id", "name").where("consistent_value = 'کتاب'").collect()
    assert [(g.n_forms, g.n_rows) for g in groups] == [(2, 3)]
    assert C.inconsistent_values(df.limit(0), "row_id", ["name"], "t").count() == 0
    assert df.select(F.sum(F.when(C.consistent_column("name") == "کتاب", 1))).first()[0] == 3


def test_other_scripts_and_members(spark):
    for a, b in (("ɡ", "g"), ("ո", "n"), ("Ꭺ", "A"), ("ꓢ", "S"), ("Ⲟ", "O"), ("\x07a", "a")):
        assert C.skeleton(a) == C.skeleton(b)
    assert C.consistent("LIꓢU") == "LISU" and C.consistent("ꓢꓮ") == "ꓢꓮ" and C.consistent("Armeոia") == "Armenia"
    rows = [("a", 1, "قانون"), ("a", 2, "قانون"), ("b", 1, "ﻗﺎﻧﻮﻥ"), ("b", 2, None), ("b", 3, ""), ("b", 4, "сор"), ("b", 5, "cop")]
    found = {(r.t, r.i): r for r in C.look_alike_members(spark.createDataFrame(rows, "t string, i long, value string"), "value").collect()}
    assert len(found) == 6 and (found["a", 1].n_forms, found["a", 1].n_rows) == (2, 3) and found["b", 1].skeleton_hash == found["a", 2].skeleton_hash
    assert (found["b", 4].n_forms, found["b", 3].n_rows) == (2, 1)
    values = spark.createDataFrame(rows, "t string, i long, value string")
    assert [(r.i, r.consistent_value) for r in C.inconsistent_values(values, "i", ["value"], "x").collect()] == [(1, "قانون")]
