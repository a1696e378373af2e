import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import residue as R

LAW = "مرجع بدوی در بررسی بدافزار یادآور شد که طرف مقابل کد منبع را کپی کرد."


def test_texts(spark):
    texts = [
        LAW, f"{LAW}\nمنظور از خطای ۴۰۴ در این آیین‌نامه، نبود نشانی صفحه است.", f"{LAW}\nنرخ %۵ و $۱۰ در جدول آمده است.", f"{LAW}\nعبارت [اصلاحی ۱۳۹۸] و مجموعه {{الف، ب، ج}} افزوده شد.",
        "404 Not Found - the requested page does not exist", "صفحه اصلی\nورود\nPlease enable JavaScript to view this page.", "lorem ipsum متن نمونه lorem ipsum",
        f"{LAW} مبلغ {{{{content}}}} ریال", f"{LAW} رقم ${{شماره}} است", "خطای ۴۰۴: صفحه مورد نظر یافت نشد", "سرور در حال حاضر پاسخگو نیست. کد ۵۰۳\nبازگشت به صفحه اصلی", None, "", f"{LAW}\nصفحه اصلی",
        f"{LAW}\nجای خالی فرم با ........ مشخص است", f"{LAW} __شماره__ و %نام مرجع%",
    ]
    menus = ["صفحه اصلی\nورود\n" + LAW + f" {i}" for i in "ابپتث"] + [f"بازگشت به صفحه اصلی\n{LAW} {i}" for i in "ابپت"]
    df = spark.createDataFrame([(i, t, "https://a.example/x") for i, t in enumerate(texts + menus)], "row_id long, text string, url string")
    found = {r.row_id: r.reason for r in R.residue_texts(df, "row_id", "text", "url").collect()}
    assert found == {4: "residue", 5: "residue", 6: "residue", 7: "placeholder", 8: "placeholder", 9: "residue", 10: "residue", 15: "placeholder"}
    assert R.without(df, R.residue_texts(df, "row_id", "text", "url"), "row_id").count() == df.count() - len(found)
    assert R.residue_texts(df.limit(0), "row_id", "text", "url").count() == 0


def test_statuses(spark):
    df = spark.createDataFrame([(1, "public"), (2, "undefined"), (3, None), (4, ""), (5, "\n%s"), (6, "subscribed"), (7, "undefined")], "row_id long, s string")
    assert sorted(r.row_id for r in R.bad_statuses(df, "row_id", "s", R.FILE_STATUSES).collect()) == [2, 5, 7]


def test_lines_and_long_placeholders(spark):
    ids = [f"Gateway timed out after 500 ms\nRay 00b{i}0f83832f" for i in range(3)]
    copies = ["Access denied\n" + LAW] * 4
    long = f"{LAW} {{{{ {'x' * 100} }}}}", f"{LAW} __{'نام' * 30}__", f"{LAW} [{'نام ' * 30}را وارد کنید]", f"{LAW}\u2028<%= {'y' * 200} %>"
    discuss = ["؛ ".join([LAW] * 4) + " Access denied. " + LAW]
    df = spark.createDataFrame(list(enumerate([*ids, *copies, *long, *discuss])), "k long, t string").selectExpr("k", "t", "CAST(NULL AS STRING) AS u", "1 AS n", "'x' AS host", "'y' AS lines")
    found = {r.k: r.reason for r in R.residue_texts(df, "k", "t", "u").collect()}
    assert found == {0: "residue", 1: "residue", 2: "residue"} | dict.fromkeys(range(7, 11), "placeholder")


def test_http_reasons():
    assert all(R.evidence(R.normal_line(x)) for x in ("418 I'm a Teapot", "۵۰۲ Bad Gateway", "HTTP 451 Unavailable For Legal Reasons", "KeyError: 'title'"))
    assert not any(R.evidence(R.normal_line(x)) for x in (LAW, "the parties may not be found at 12 Green Lane", "errors of law"))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_every_form_holds_what_it_needs(data):
    need, form = data.draw(st.sampled_from(R.ERROR + R.SCRIPT + R.FILLER + R._HTTP))
    assert need in data.draw(st.from_regex(re.compile(form, re.ASCII), fullmatch=False)).lower()
