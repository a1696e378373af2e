import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import personal as P


@pytest.fixture(scope="module")
def lexicon(spark):
    names = spark.createDataFrame([("نگار نیک‌زاده",), ("نگار پاک‌نیا سنگ‌چینی",), ("کاوه نیکزاده",), (None,), ("",)], "name string")
    texts = spark.createDataFrame([("اینجانب نگار نیکزاده هستم",), ("آقای تیرمنش آمد",), ("My name is Ladan Azarpour here",), (None,)], "t string")
    return P.learn(texts, names)


@pytest.fixture(scope="module")
def kind(lexicon):
    return P.exact({r.h % (1 << 64): r.kinds for r in lexicon.words.collect()})


def kinds(text, kind):
    return [(k, text[a:b]) for a, b, k in P.items(text, kind)]


def number(nine):
    r = sum(int(d) * (10 - i) for i, d in enumerate(nine)) % 11
    return nine + str(r if r < 2 else 11 - r)


def test_forms(kind):
    n = number("963913287")
    assert kinds("پاسخ را به Tаra_78 @ post . invalid بفرستید", kind) == [("email", "Tаra_78 @ post . invalid")]
    assert kinds("Send to sina+dad [at] vakil dot test please", kind) == [("email", "sina+dad [at] vakil dot test")]
    for phone in ("0979 392 56 98", "+98 71 16455520", "۰۹۸۷-۳۴۳-۸۲۷۸", "(051) 1452 7584", "15139732-041", "００９８９８７２５９５５７８"):
        assert [k for k, _ in kinds(f"تماس: {phone} است", kind)] == ["phone"], phone
    assert kinds("صفر نه هفت هفت چهار چهار یک پنج هشت نه چهار دو شاهد", kind) == [("phone", "صفر نه هفت هفت چهار چهار یک پنج هشت نه چهار")]
    assert kinds(f"کد ملی {n[:3]}-{n[3:9]}-{n[9]} است", kind) == [("identity_number", f"{n[:3]}-{n[3:9]}-{n[9]}")]
    wrong = n[:9] + str((int(n[9]) + 1) % 10)
    for ordinary in (f"کد ملی {wrong} است", f"شناسه واریز {n} ثبت شد", "شماره پرونده 44586599765300 است", "https://portal.example.org/khadamat", "در خیابان اصلی شهر مرغزار", "پلاک ثبتی"):
        assert kinds(ordinary, kind) == [], ordinary
    address = "خیابان یاسمن سوم، کوچه گل‌ابریشم، پلاک 172، کد پستی 6035199238"
    assert kinds(f"ساکن {address} هستم.", kind) == [("address", address)]
    assert kinds("نشانی ملک چشمه‌ناز، خ شقایق، ک زرشک، پلاک ۳۲۰، واحد ۲۱ است", kind) == [("address", "چشمه‌ناز، خ شقایق، ک زرشک، پلاک ۳۲۰، واحد ۲۱")]
    assert kinds("I live at No. 3, Third Alley, Kaj Street, Abrang near", kind) == [("address", "No. 3, Third Alley, Kaj Street, Abrang")]


def test_names(kind):
    assert kinds("وکیل او نگار پاک‌نیا سنگ‌چینی بود", kind) == [("name", "نگار پاک‌نیا سنگ‌چینی")]
    assert kinds("طرف دعوا سركار خانم تیر‌منش است", kind) == [("name", "سركار خانم تیر‌منش")]
    assert kinds("by Ladan Azarpour himself", kind) == [("name", "Ladan Azarpour")]
    assert kinds("نیکزاده تنها آمد و نگار رفت", kind) == []


def test_redaction(spark, lexicon, kind):
    text = "اینجانب نگار ﻧﯿﮑﺰﺍﺩﻩ با 09793925698 و a@b.example"
    assert P.replaced(text, P.items(text, kind)) == "اینجانب [NAME] با [PHONE] و [EMAIL]"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text), (4, "نگار نیکزاده"), (None, text)], "row_id long, u string").withColumn("h", F.lit("x"))
    out = sorted((r.row_id or 0, r.u or "") for r in P.redacted(df, ["u"], lexicon).collect())
    assert out == [(0, "اینجانب [NAME] با [PHONE] و [EMAIL]"), (1, "اینجانب [NAME] با [PHONE] و [EMAIL]"), (2, ""), (3, ""), (4, "[NAME]"), (4, "اینجانب [NAME] با [PHONE] و [EMAIL]")]
    found = P.found_items(df, "row_id", "u", lexicon).collect()
    assert len(found) == 10 and {r.occurrence for r in found} == {1}
    assert P.found_items(df.limit(0), "row_id", "u", lexicon).count() == 0


@pytest.mark.parametrize("text, want", [
    ("خیابان آزادی، ش ۱۲", "address"), ("12, Green Lane", "address"), ("12, Green Boulevard", "address"), ("3, Kaj Square", "address"),
    ("خیابان آزادی، " + "، ".join(f"کوچه گل{'آبپتثج'[i % 6]}" for i in range(12)) + "، پلاک ۷" + "، واحد ۲" * 6, "address"),
])
def test_whole_forms(kind, text, want):
    found = kinds(f"{text} است", kind)
    assert found == [(want, text)]


def test_spoken_identity_without_zero(kind):
    n = next(x for x in map(number, ("123456789", "987654321", "111222333", "234567891", "345678912")) if "0" not in x)
    said = " ".join("یک دو سه چهار پنج شش هفت هشت نه".split()[int(d) - 1] for d in n)
    assert kinds(f"کد ملی {said} است", kind) == [("identity_number", said)]


def test_no_stranger_is_a_name_beside_a_large_register(spark):
    """A million register names fill the bitmaps; the join leaves only true names."""
    letters = F.translate(F.col("id").cast("string"), "0123456789", "ابپتثجچحخد")
    names = spark.range(1_000_000).select(F.concat(F.lit("نام"), letters, F.lit(" خاندان"), letters).alias("name"))
    strangers = [f"بیگانه{a}{b} ناشناس{b}{a}" for a in "ابپتثجچحخد" for b in "رزسشصضطظعغ"]
    rows = [(i, f"دیروز {s} را دیدم") for i, s in enumerate(strangers)] + [(900, "دیروز نامبپت خاندانبپت را دیدم")]
    df = spark.createDataFrame(rows, "row_id long, t string")
    lexicon = P.learn(df.select("t"), names)
    assert lexicon.words.count() >= 2_000_000
    assert [(r.row_id, r.pii_type) for r in P.found_items(df, "row_id", "t", lexicon).collect()] == [(900, "name")]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "t string")
    lexicon = P.learn(empty, empty.withColumnRenamed("t", "name"))
    assert not any(np.any(m) for m in lexicon.maps) and not lexicon.words.head(1)
