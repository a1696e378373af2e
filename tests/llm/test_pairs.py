from textloom.llm import pairs as P

FA = "مطابق ماده {} قانون حمایت از {}، خوانده {} روز فرصت دارد و باید دادخواست بدهد. شهادت دو نفر درباره {} کفایت می‌کند."
EN = "You should file a separate claim for {} with the board. The fee for {} is about {} rials and the rule is on this file."


def test_defects(spark):
    words = ["مهریه", "نفقه", "طلاق", "سهام", "چک", "باغ", "بیمه", "حضانت"]
    rows = [(i, f"آیا برای {words[i % 8]} باید به دادگاه بروم یا نامه {i} از کارفرما کافی است؟", FA.format(i, words[i % 8], i, words[(i + 3) % 8])) for i in range(1, 60)]
    rows += [(100 + i, f"Do I need to go to the court for {i} or is the letter of the owner enough?", EN.format("guarantee", "delivery", i)) for i in range(40)]
    q = "آیا برای مهریه باید به دادگاه عمومی بروم یا عقدنامه کافی است؟ کارشناس آن را کمتر حساب کرد."
    rows += [
        (901, q, None), (902, q, " ‌​"), (903, q, "***"), (904, q, q), (905, q, "سلام " + q), (906, q, "متأسفانه امکان پاسخ به این پرسش را ندارم. از شخص دیگری بپرسید."),
        (907, q, EN.format("dowry", "marriage", 7)), (908, q, "مطابق ماده ۵ قانون حمایت از باغ، خوانده ۳ روز فرصت دارد و باید"), (909, q, "شهادت دو نفر درباره نفقه کفایت می‌کند. مطابق ماده ۵ قانون حمایت از"),
        (910, q, "نمی‌توانم نتیجه را تضمین کنم اما مسیر روشن است. شهادت دو نفر درباره چک کفایت می‌کند."), (911, q, "شهادت دو نفر درباره چک کفایت می‌کند"), (912, None, FA.format(1, "چک", 2, "باغ")),
        (913, "", FA.format(1, "چک", 2, "باغ")), (914, q, "نسبت به چک تا ۵ روز،"),
    ]
    df = spark.createDataFrame(rows, "row_id long, question string, answer string").withColumnRenamed("row_id", "k2").withColumnRenamed("k2", "row_id")
    found = {r.row_id: r.defect for r in P.broken_pairs(df).collect()}
    assert found == {
        901: "empty", 902: "empty", 903: "empty", 904: "copied_question", 905: "copied_question", 906: "refusal", 907: "other_language", 908: "truncated", 909: "truncated", 914: "truncated",
    }
    assert P.broken_pairs(df.limit(0)).count() == 0


def test_copied_share():
    assert P.copied_share("a b c d".split(), "x a b c d y".split()) == 1.0
    assert P.copied_share([], ["a"]) == 0.0 and P.copied_share(["a"], ["a"]) == 1.0
