import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import html, readers, writers
from textloom.streaming import crawl_log


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes("﻿".encode() + b'{"a": 1}\n\n  \nnot json\n{"a": 2}\n')
    got = [(r.source_line, r.record.a if r.record else None) for r in readers.jsonl_numbered(spark, str(p), "a int").collect()]
    assert got == [(1, 1), (4, None), (5, 2)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(bad), "a int").collect()
    assert readers.jsonl_tolerant(spark, str(bad), "a int").count() == 1


def test_manifest(spark, tmp_path):
    m, c = tmp_path / "m.jsonl", tmp_path / "c.jsonl"
    m.write_text("\n".join(json.dumps(x) for x in ({"title": "t", "file_url": "u", "type_file": "PDF"}, {"title": "s", "file_url": "v", "type_file": "word"}, {"title": "z", "file_url": "w", "type_file": "pdf"})))
    c.write_text("\n".join(json.dumps(x) for x in ({"file_url": "u", "id": "1"}, {"file_url": "u", "id": "2", "local_path": "p"})))
    got = {r.file_url: (r.id, r.local_path) for r in readers.manifest(spark, str(m), str(c)).collect()}
    assert got["u"] == ("2", "p") and got["w"][0].startswith("legal_file:") and "v" not in got


def test_queues(spark):
    df = spark.createDataFrame([("10", "done"), ("9", None), ("x", "error"), ("2", "pending")], "k string, s string")
    assert [r.k for r in readers.queue(df, "s", "k").collect()] == ["x", "2", "9"]
    assert sorted(r.id for r in readers.id_range(spark, 1, 4, spark.createDataFrame([(2,)], "id long")).collect()) == [1, 3, 4]
    assert readers.retry_delay(10) == 60.0 and readers.retry_delay(1) == 2.0 and readers.retry_delay(1, 5.0) == 5.0


PAGE = """<html><head><title>عنوان | سایت</title><script>x='<p>no</p>'</script></head><body><nav><a href="/rules/files/lists">menu</a></nav>
<h1>قانون کار</h1><p>ورود</p><p>سطر یک &amp; دو</p><div>سطر یک &amp; دو</div><a href="/f/a.pdf" download>دانلود</a> <a href="#x">دریافت</a>
<a href="https://b.example/show/3">دانلود</a><audio src="s.mp3"></audio></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "https://a.example/rules/", PAGE), (2, "https://a.example/", None), (3, "https://a.example/", "<p>broken <b>x")], "page_id long, url string, html string")
    read = df.withColumn("p", html.parsed("html"))
    row = read.select("page_id", html.page_title(F.col("p"), F.lit("id")).alias("t"), html.main_lines(F.col("p"), ["ورود"]).alias("ls")).orderBy("page_id").collect()
    assert row[0].t == "قانون کار" and row[0].ls[0] == "سطر یک & دو" and row[0].ls.count("سطر یک & دو") == 1
    assert row[1].t == "id" and row[1].ls is None and row[2].ls == ["broken x"]
    assert [r.url for r in html.links(df, "page_id", "url", "html").orderBy("position").collect()][1] == "https://a.example/f/a.pdf"
    best = html.download_link(df, "page_id", "url", "html", "a.example").collect()
    assert [(r.page_id, r.file_url, r.score) for r in best] == [(1, "https://a.example/f/a.pdf", 21)]
    assert df.select(html.unescaped(F.lit("a &amp; b"))).first()[0] == "a & b"


def test_unclosed_elements_end_with_the_one_around_them(spark):
    page = "<body><div><form><p>menu</div><p>one</p><main><aside>x<p>y</main><p>two</p><button>b</body>"
    assert html.read(page)["lines"] == ["one", "two"]


def content(spark, page, **options):
    df = spark.createDataFrame([(page,), (None,)], "h string")
    found = [r.c for r in df.select(html.content("h", F.lit("id"), ("منو",), **options).alias("c")).collect()]
    assert found[1] is None
    return tuple(found[0])


def test_content_container(spark):
    long = "متن قانون " * 40
    assert content(spark, f"<body><div>other</div><main><h1>عنوان</h1><form><p>no</form><p>{long}</p><p>{long}</p><p>منو</p><p>پایان</p></main></body>")[:2] == ("عنوان", f"{long.strip()}\nپایان")
    around = f"<body><p>outside</p><div id=a><div id=b><h1>عنوان</h1></div><article>short</article><p>{long}</p></div></body>"
    assert content(spark, around)[1] == f"short\n{long.strip()}"
    assert content(spark, "<body><p>a</p><div class='social'>b</div><p>c</p></body>")[1] == "a\nc"


def test_titles(spark):
    assert content(spark, "<body><ol class='breadcrumb'><a href=/>خانه</a> <a href=/l>قوانین</a> قانون کار</ol></body>")[0] == "قانون کار"
    assert content(spark, "<head><title>x | قانون کار - سایت</title></head>", site="سایت")[0] == "قانون کار"
    assert content(spark, "<body>a")[0] == "id"


def test_ruling_pages(spark):
    body = "".join(f"<p>{x}</p>" for x in ("مقدمه", "تاریخ تصویب: ۱۳۹۹/۱/۲", "موضوع: الف", "۱۲۰,۰۰۰ تومان", "متن رأی", "رأی وحدت رویه شماره ۷"))
    assert content(spark, f"<body><h1>رأی</h1>{body}</body>", ruling=True) == ("رأی", "تاریخ تصویب: ۱۳۹۹/۱/۲\nموضوع: الف\nمتن رأی", "public")
    assert content(spark, "<body><h1>رأی</h1><p>اشتراک سه ماهه</p><p>اشتراک یک ساله</p></body>", ruling=True) == ("رأی", "", "paywalled")
    assert content(spark, "<body><h1>رأی</h1></body>", ruling=True)[1:] == ("", "empty")


def test_consultation_cards(spark):
    card = "<div class='advice-item'><span>1399/01/0{i}</span><h3>عنوان {i}</h3><p>پرسش {i} درباره ملک</p><div class='reply'>پاسخ {i} وکیل است</div><button>مشاهده</button></div>"
    cards = "".join(card.format(i=i) for i in (1, 2, 2))
    page = f"<body><h1>x</h1><div>{cards}</div><p>1400/1/1</p><div><div><b>1401/2/3</b><p>عنوان دیگر</p><p>پرسش دیگر در این باره</p><p>پاسخ پایانی</p></div></div></body>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = [[(c.advice_date, c.title, c.question, c.answer) for c in r.c] for r in df.select(html.consultation_cards("h").alias("c")).collect()]
    assert got[1] == [] and got[0] == [
        ("1399/01/01", "عنوان 1", "پرسش 1 درباره ملک", "پاسخ 1 وکیل است"), ("1399/01/02", "عنوان 2", "پرسش 2 درباره ملک", "پاسخ 2 وکیل است"),
        ("1401/2/3", "عنوان دیگر", "پرسش دیگر در این باره", "پاسخ پایانی"),
    ]


def test_lawyer_profile(spark):
    page = """<body><h1>سارا راد</h1><h2>درباره من</h2><p>وکیل <b>پایه یک</b></p><p>s@r.example</p><h2>حوزه‌های تخصصی</h2><ul><li>خانواده</li><li>خانواده</li><li>ملک</li><li>مشاهده</li></ul>
    <h3>تماس</h3><span>شهر محل فعالیت:</span><span>شیراز</span><span>شماره پروانه</span><span>۱۲۳</span></body>"""
    p = spark.createDataFrame([(page,), (None,)], "h string").select(html.lawyer_profile("h").alias("p")).collect()
    assert p[1].p is None and (p[0].p.name, p[0].p.city, p[0].p.license_number, p[0].p.email, p[0].p.address) == ("سارا راد", "شیراز", "۱۲۳", "s@r.example", "")
    assert p[0].p.specialties == ["خانواده", "ملک"] and p[0].p.about == "وکیل\nپایه یک\ns@r.example"


def test_categories(spark):
    pages = [
        '<a href="/rules/childs/3">خانواده</a><a href="/rules/childs/4/x">کار</a><a href="/x">z</a>', "<nav><a>صفحه اصلی</a><span>فایل حقوقی</span><span>ثبت</span></nav><h1>عنوان</h1>",
        "<ul class=breadcrumb><li>بیمه</li><li>عنوان</li></ul><h1>عنوان</h1>", "<p>x</p>", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    assert [r.c for r in df.select("i", html.category("h").alias("c")).orderBy("i").collect()] == ["کار", "ثبت", "بیمه", "نامشخص", None]


def test_profile_links(spark):
    page = """<div class=card><h3>سارا راد</h3><p><a href="/lawyer-information.php?lawyerID=5#top">مشاهده سوابق</a></p></div>
    <div><a href="/lawyer-information.php?lawyerID=6">نام دوم</a></div><div><div><a href="lawyer-information.php?x=1&lawyerID=7"></a></div><img alt="نام سوم"></div><a href="/lawyer-information.php">z</a>"""
    df = spark.createDataFrame([(1, "https://a.example/list", page), (2, "https://a.example/", None)], "p long, u string, h string")
    got = sorted((r.lawyer_id, r.profile_url, r.listing_name) for r in html.profile_links(df, "p", "u", "h").collect())
    base = "https://a.example/lawyer-information.php?"
    assert got == [("5", base + "lawyerID=5", "سارا راد"), ("6", base + "lawyerID=6", "نام دوم"), ("7", base + "x=1&lawyerID=7", "نام سوم")]


def test_lines_end_at_line_ends_only(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('\ufeff{"t": "a\u2028b\x85c"}\r\n\nnot json\r{"t": "d"}'.encode())
    path = str(tmp_path / "a.jsonl")
    got = [(r.source_line, r.record.t if r.record else None) for r in readers.jsonl_numbered(spark, path, "t string").orderBy("source_line").collect()]
    assert got == [(1, "a\u2028b\x85c"), (3, None), (4, "d")]
    assert [r.source_line for r in readers.jsonl_numbered(spark, path, "t string", "drop").orderBy("source_line").collect()] == [1, 4]
    with pytest.raises(Exception):
        readers.jsonl_numbered(spark, path, "t string", "raise").collect()


def test_ordered_lines(spark, tmp_path):
    writers.jsonl(spark.range(1000).selectExpr("1000 - id AS n"), str(tmp_path / "o"), ["n"])
    import json

    read = [json.loads(x)["n"] for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines()]
    assert read == sorted(read) and len(read) == 1000


def test_cards_and_profiles(spark):
    df = spark.createDataFrame([(["x", "۱۳۹۹/۱/۲", "ت", "س", "پ۱", "پ۲", "1400/02/03", "t", "q", "۱۴۰۰/۱/۱", "کوتاه"],)], "s array<string>")
    cards = df.select(html.cards(F.col("s")).alias("c")).first().c
    assert [(c.advice_date, c.title, c.question, c.answer) for c in cards] == [("۱۳۹۹/۱/۲", "ت", "س", "پ۱\nپ۲"), ("1400/02/03", "t", "q", "")]
    p = spark.createDataFrame([(["شهر", "شیراز", "آدرس", "خیابان ۱", "x a@b.ir"],)], "s array<string>").select(html.profile(F.col("s")).alias("p")).first().p
    assert (p.city, p.address, p.email) == ("شیراز", "خیابان ۱", "a@b.ir")
    found = spark.createDataFrame([(1, "https://a/x?lawyerID=5", "نام"), (1, "https://a/x?lawyerID=5", "نام بلند"), (1, "https://a/x", "z")], "page long, url string, text string")
    assert [(r.lawyer_id, r.listing_name) for r in html.listing(found, "page").collect()] == [("5", "نام بلند")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", [])], "id long, type string, l array<string>")
    writers.routed_jsonl(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "_by=a")).count() == 1
    writers.csv(df, str(tmp_path / "c"))
    assert {r.l for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"x | y", None}
    for _ in range(2):
        writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    writers.sharded(df.withColumn("shard", F.col("id")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "shard=2")).count() == 1
    for rows in (df, df.where("id = 2").withColumn("type", F.lit("c"))):
        writers.upsert_parquet(rows, str(tmp_path / "u"), "id")
    assert sorted((r.id, r.type) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [(1, "a"), (2, "c")]


def test_marked_and_ordered_csv(spark, tmp_path):
    df = spark.createDataFrame([(i, "متن") for i in range(300, 0, -1)], "id long, t string")
    writers.csv(df, str(tmp_path / "c"), order=["id"], mark=True)
    files = sorted((tmp_path / "c").glob("part-*"))
    assert all(f.read_bytes().startswith("\ufeffid,t".encode()) for f in files)
    read = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert read == list(range(1, 301))


def test_crawl_log(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    event = lambda u, s, t: json.dumps({"url": u, "status": s, "http_status": 200, "fetched_at": t})
    (source / "1.json").write_text("\n".join([event("a", "error", "2024-01-01T00:00:00Z"), event("b", "done", "2024-01-01T00:00:00Z")]))
    crawl_log.keep_state(crawl_log.events(spark, str(source)), state, str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text(event("a", "done", "2024-01-02T00:00:00Z"))
    crawl_log.keep_state(crawl_log.events(spark, str(source)), state, str(tmp_path / "ck")).awaitTermination()
    got = {r.url: (r.attempt_count, r.status) for r in spark.read.parquet(f"{state}/version=1").collect()}
    assert got == {"a": (2, "done"), "b": (1, "done")}
    assert crawl_log.windowed_counts(crawl_log.events(spark, str(source))).isStreaming


def test_terminal_pages_are_not_crawled_again(spark):
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 0, m)
    old = spark.createDataFrame([("a", "done"), ("b", "error")], "url string, status string")
    new = [("a", "error", at(1)), ("b", "done", at(2)), ("b", "error", at(3)), ("c", "error", at(1)), ("c", "error", at(2)), ("d", "pending", None)]
    rows_ = spark.createDataFrame(new, "url string, status string, fetched_at timestamp").withColumn("http_status", F.lit(1))
    got = {r.url: (r.status, r.attempt_count) for r in crawl_log.state_of(crawl_log.unfinished(rows_, old, ("done",))).collect()}
    assert got == {"b": ("done", 1), "c": ("error", 2), "d": ("pending", 1)}
