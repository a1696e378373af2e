import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from textloom.functions import ids, text, urls


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()[0]


def test_normal_forms(spark):
    x = "  «كتاب (يك)»  ۱۲٣‌: "
    assert one(spark, text.normalize_law("x"), x) == "کتاب یک 123 :"
    assert one(spark, text.normalize_ruling("x"), x) == "کتاب (یک) 123 :"
    assert one(spark, text.normalize_file("x"), x) == "«کتاب (یک)» 123 :"
    assert one(spark, text.normalize_profile("x"), "نام‌كامل: ") == "نام کامل"
    assert one(spark, text.normalize_space_keep_lines("x"), " a \t b\n c") == "a b\n c"
    for f in (text.normalize_space, text.normalize_law, text.clean_advice):
        assert one(spark, f("x"), None) == ""
    assert one(spark, text.strip("x"), " a b\n") == "a b"


def test_numbers(spark):
    assert one(spark, text.number_tokens("x"), "مواد ۱۲ و ٣ تا 4") == ["12", "3", "4"]
    assert one(spark, text.legal_number_tokens("x"), "۵ مکرر و سه و 7") == ["5_مکرر", "3", "7"]
    assert one(spark, text.decision_number_tokens("x"), "(ر) ۷۴ و ۶۵۰/۲") == ["(ر)74", "650/2"]
    assert one(spark, text.decision_key("x"), "شماره ۷ ۴") == "74"


def test_decision_fields(spark):
    assert one(spark, text.year("x"), "سال ۱۳۹۸") == "1398" and one(spark, text.year("x"), "۹۹") is None
    assert one(spark, text.decision_number("x"), "رأی وحدت رویه شماره ۷۹۴ مورخ ۱۳۹۹") == "794"
    assert one(spark, text.approval_date("x"), "تاریخ تصویب: ۱۳۹۹ / ۵ / ۲۱") == "1399/5/21"
    assert one(spark, text.subject("x"), "الف\nموضوع: مهریه زن\nب") == "مهریه زن"
    assert one(spark, text.subject("x"), "موضوع:\nنفقه\nب") == "نفقه"
    long = "موضوع: " + "واژه " * 40 + "نظر به " + "دیگر " * 200
    assert one(spark, text.subject("x"), long) == ("واژه " * 40).strip()
    assert one(spark, text.issuing_body("x"), "رأی هیات عمومی دیوان عالی کشور است") == "هیأت عمومی دیوان عالی کشور"
    assert one(spark, text.approval_line("x"), "الف\nمصوب  ۱۳۹۰\nب") == "مصوب ۱۳۹۰"


def test_titles(spark):
    assert one(spark, text.legal_title("x"), "قانون مدنی مصوب ۱۳۰۷") == "قانون مدنی"
    assert one(spark, text.title_candidate("x"), "قانون کار که لازم است") == "قانون کار"
    assert one(spark, text.site_title("x", "سایت"), "قانون کار | سایت ما") == "قانون کار"
    assert one(spark, text.safe_filename("x"), 'a/b:"c"?. ') == "a_b__c"
    assert one(spark, text.page_filename("x"), "document:show:1") == "document_show_1.html"
    assert one(spark, text.clip("x", 3), "ab cd") == "ab…" and one(spark, text.clip("x", 9), "ab") == "ab"


def test_relations(spark):
    assert one(spark, text.law_relation("x"), "این ماده لغو و اصلاح شد") == "REPEALS"
    assert one(spark, text.law_relation("x"), "در اجرای ماده") == "IMPLEMENTS"
    assert one(spark, text.ruling_relation("x"), "به موجب ماده") == "APPLIES"
    assert one(spark, text.decision_relation("x"), "مخالف رأی") == "DISTINGUISHES_DECISION"


def test_lists(spark):
    assert one(spark, text.json_list("x"), '["a","b"]') == ["a", "b"] and one(spark, text.json_list("x"), "[a") == []
    assert one(spark, text.literal_object("x"), "{a: 1, 'b': 'x', a: true}") == {"a": "true", "b": "x"}
    assert one(spark, text.header_map("x"), "k=v; k2 = v=2; bad") == {"k": "v", "k2": "v=2"}
    df = spark.createDataFrame([(["ایمیل", "a@b.c", "آدرس:", "خیابان", "شهر"],)], "s array<string>")
    assert df.select(text.label_value("s", ["آدرس"], ["شهر"])).first()[0] == "خیابان"
    assert df.select(text.label_value("s", ["شهر"], [])).first()[0] is None
    same = spark.createDataFrame([(["شهر: شیراز"],)], "s array<string>")
    assert same.select(text.label_value("s", ["شهر"], [])).first()[0] == "شیراز"


def test_markers(spark):
    df = spark.createDataFrame([("a [S1] b [S99] [S1]",)], "x string")
    row = df.select(text.markers("x").alias("m"), text.strip_markers("x", F.array(F.lit("S1"))).alias("s")).first()
    assert row.m == ["S1", "S99"] and row.s == "a [S1] b  [S1]"


def test_access(spark):
    assert one(spark, text.paywalled("x"), "خرید‌اشتراک و اشتراک سه ماهه") is True
    assert one(spark, text.paywalled("x"), "خرید اشتراک و اشتراک سه ماهه موضوع: مهریه") is False
    access = lambda x, f, a: one(spark, text.file_access("x", F.lit(f), F.lit(a)), x)
    assert [access("رمز عبور", True, True), access("خرید اشتراک", False, True), access("a", True, True), access("a", True, False), access("a", False, False)] == [
        "unauthorized", "paywalled", "subscribed", "public", "missing_file"]
    missing = lambda s, t, c: one(spark, text.looks_missing(F.lit(s), F.lit(t), "x"), c)
    assert missing(404, "", "x") and missing(200, "Page Not Found", "x") and missing(200, "a", "موردی یافت نشد") and not missing(200, "a", "موردی یافت نشد" + " x" * 500)


@pytest.mark.parametrize("x, flag", [("1", True), ("Yes", True), ("off", False), (None, False)])
def test_flags(x, flag):
    assert text.env_flag(x) is flag


def test_now(spark):
    now = datetime.datetime.fromisoformat(one(spark, text.now_iso(), "x"))
    assert abs((now - datetime.datetime.now(datetime.timezone.utc)).total_seconds()) < 300


def test_ids(spark):
    assert one(spark, ids.uuid5(uuid.NAMESPACE_URL, F.col("x")), "متن\x00a") == str(uuid.uuid5(uuid.NAMESPACE_URL, "متن\x00a"))
    assert one(spark, ids.stable_id("tag", "x"), " Straße ") == one(spark, ids.stable_id("tag", "x"), "STRASSE")
    assert one(spark, ids.note_id(F.lit("a"), F.lit(None).cast("string"), F.lit(2)), "") == "note:a:2"
    assert one(spark, ids.file_id(F.lit(""), F.lit("u"), F.lit("t"), F.lit("p")), "").startswith("legal_file:")


def test_urls(spark):
    u = "HTTPS://A.Example//rules/legals//show/12/slug%20x/?q=1&page=3#f"
    assert one(spark, urls.canonical("x"), u) == "https://a.example/rules/legals/show/12"
    assert one(spark, urls.canonical("x", keep_page=True), u) == "https://a.example/rules/legals/show/12?page=3"
    assert one(spark, urls.canonical("x"), "https://a.example") == "https://a.example/" and one(spark, urls.canonical("x"), "nothing") is None
    patterns = [("document", "child", r"/childs/show/(\d+)(?:/|$)"), ("category", "parent", r"/parent/(\d+)(?:/|$)"), ("document", "show", r"/show/(\d+)(?:/|$)"), ("index", "lists", r"/lists(?:/|$)")]
    route = lambda x: one(spark, urls.route("x", "a.example", "/rules/legals/", patterns)["node_id"], x)
    assert route("https://a.example/rules/legals/childs/show/7/x") == "document:child:7"
    assert route("https://a.example/rules/legals/lists") == "index:lists" and route("https://b.example/rules/legals/show/7") is None
    assert one(spark, urls.with_parameter("x", "page", F.lit(4)), "https://a/x?page=1") == "https://a/x?page=4"
    assert one(spark, urls.with_parameter("x", "page", F.lit(4)), "https://a/x") == "https://a/x?page=4"
    kind = lambda x, m: one(spark, urls.file_kind("x", F.lit(m)), x)
    assert [kind("https://a/x.DOCX?z", None), kind("https://a/x", "application/pdf; q"), kind("https://a/x", "audio/x"), kind("https://a/x", None)] == ["word", "pdf", "audio", "unknown"]
