"""Column functions over text: normal forms, titles, numbers, dates, relation types. All run in the JVM.

Each variant of a normal form is a function of its own; NULL is treated as '' where a normal form is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, letters and spaces that normal forms replace.
DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
LETTERS, PLAIN_LETTERS = "يىكۀةؤإأٱ", "ییکههوااا"
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Words where a law's title ends, and number words.
TITLE_STOPS = ("که", "می باشد", "است", "خواهد", "گردید", "موضوع", "مصوب", "و تبصره", "و بند", "در خصوص")
RULING_STOPS = ("که", "می باشد", "است", "خواهد", "گردید", "موضوع", "مصوب", "در خصوص", "با اصلاحات")
NUMBER_WORDS = {"یک": "1", "دو": "2", "سه": "3", "چهار": "4", "پنج": "5", "شش": "6", "هفت": "7", "هشت": "8", "نه": "9", "ده": "10"}
# Institutions, notices of subscription and login, and the forms of dates, addresses and markers.
INSTITUTIONS = (
    "هیأت عمومی دیوان عالی کشور",
    "هیات عمومی دیوان عالی کشور",
    "هیأت عمومی دیوان عدالت اداری",
    "هیات عمومی دیوان عدالت اداری",
    "هیأت عمومی دیوان عالی انتظامی قضات",
    "هیات عمومی دیوان عالی انتظامی قضات",
    "شورای عالی ثبت",
)
PAYWALL_MARKERS = ("اشتراک سه ماهه", "اشتراک شش ماهه", "اشتراک یک ساله", "خرید اشتراک", "خرید‌اشتراک", "تومان/ماه", "ماهیانه")
LOGIN_MARKERS = ("ورود به حساب کاربری", "شماره موبایل", "رمز عبور", "کد تایید")
DATE = r"تاریخ\s*(?:تصویب|صدور)?\s*[:：]?\s*([۰-۹٠-٩0-9]{2,4}\s*/\s*[۰-۹٠-٩0-9]{1,2}\s*/\s*[۰-۹٠-٩0-9]{1,2})"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
MARKER = r"\[(S\d+)\]"
# Where a legal title ends, forms of decision numbers, subjects, institutions and lines of approval.
TITLE_END = r"\s+(?=(?:مصوب|الحاقی|اصلاحی|مورخ|با\s+اصلاحات|با\s+الحاقات|که|می\s*باشد|خواهد\s+بود|است)(?:\s|$))"
DECISION_NUMBER = r"(?i)ر[أا]ی\s+وحدت\s*رویه(?:\s+قضایی)?\s*(?:شماره|ردیف)?\s*([\(\)رR۰-۹٠-٩0-9/\-–،,\sو]+)"
DECISION_NUMBER_END = r"\s+(?:مورخ|صادره|هیأت|هیات|موضوع)(?:\s|$)"
SUBJECT_ALONE = r"موضوع\s*[:：]\s*$"
SUBJECT_SAME = r"موضوع\s*[:：]\s*\S"
SUBJECT_VALUE = r"موضوع\s*[:：]\s*(.+)"
GENERAL_BOARD = r"((?:هیأت|هیات)\s+عمومی\s+[^\n.؛]{3,100}|شورای\s+عالی\s+ثبت)"
APPROVAL_WORD = "مصوب|تصویب|اصلاحات|الحاقات"
APPROVAL_NEAR = r"([^\n]{0,180}(?:مصوب|تصویب)[^\n]{0,180})"
REASONS = r"^(.*?)\s+(?=(?:در\s+ماده|نظر\s+به|با\s+توجه|حسب|مطابق\s+ماده|در\s+پرونده))"
# Words by which a citation's relation is known, the first that is found.
LAW_RELATIONS = (("لغو|ملغی|نسخ", "REPEALS"), ("اصلاح|الحاق|تغییر", "AMENDS"), ("اجرایی|اجرای|در اجرای", "IMPLEMENTS"))
RULING_RELATIONS = (
    ("لغو|ملغی|نسخ|منسوخ|بی اعتبار", "REPEALS_OR_DISAPPLIES"), ("اصلاح|الحاق|تغییر", "INTERPRETS_AMENDMENT"), ("در اجرای|اجرایی|اجرای", "IMPLEMENTS"),
    ("لازم الاتباع|مستند|مطابق|به موجب|با استناد", "APPLIES"),
)
DECISION_RELATIONS = (
    ("عدول|منسوخ|نسخ|بی اعتبار", "OVERRULES_DECISION"), ("تایید|صحیح و قانونی|موافق", "AFFIRMS_DECISION"), ("معارض|مغایر|مخالف", "DISTINGUISHES_DECISION"),
)
ZWNJ, RLM, LRM, BOM = "‌", "‏", "‎", "﻿"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def non_empty(x: Column | str) -> Column:
    """NULL for ''."""
    return F.when(_c(x) != "", _c(x))


def first_non_empty(*xs: Column | str) -> Column:
    """The first value that is neither NULL nor ''."""
    return F.coalesce(*[non_empty(x) for x in xs])


def normalize_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(or_empty(x), SPACE + "+", " "))


def strip(x: Column | str) -> Column:
    """The value without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def normalize_space_keep_lines(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(or_empty(x), r"[ \t\x{A0}]+", " "))


def normalize_digits(x: Column | str) -> Column:
    return F.translate(or_empty(x), DIGITS, ASCII_DIGITS)


def _letters(x: Column | str, brackets: str) -> Column:
    x = F.translate(normalize_digits(x), LETTERS, PLAIN_LETTERS)
    x = F.translate(x, ZWNJ + RLM + BOM, "   ")
    if brackets:
        x = F.regexp_replace(x, brackets, " ")
    return F.lower(normalize_space(x))


def normalize_law(x: Column | str) -> Column:
    """For laws: letters, digits, joiners; brackets and quotes become spaces."""
    return _letters(x, r"""[()\[\]«»"'`]+""")


def normalize_ruling(x: Column | str) -> Column:
    """For rulings: as for laws, but round brackets stay."""
    return _letters(x, r"""[\[\]«»"'`]+""")


def normalize_file(x: Column | str) -> Column:
    """For files: brackets and quotes stay."""
    return _letters(x, "")


def normalize_profile(x: Column | str) -> Column:
    """For profiles: four letters, no digits; direction marks vanish; colons and dashes are stripped at both ends."""
    x = F.translate(or_empty(x), "يكۀة", "یکهه")
    x = F.translate(F.replace(x, F.lit(ZWNJ), F.lit(" ")), RLM + LRM, "")
    return F.btrim(normalize_space(x), F.lit(" \t\r\n:：-"))


def clean_advice(x: Column | str) -> Column:
    return normalize_space(F.translate(or_empty(x), ZWNJ + BOM, "  "))


def site_title(x: Column | str, site: str) -> Column:
    """A page title without the site's name after a dash or bar, and without what stands before a kind of law."""
    x = F.regexp_replace(normalize_space(x), rf"(?i)\s*[-|]\s*{site}.*$", "")
    x = F.regexp_replace(x, r"^.*?\s[-–|]\s(?=(?:قانون|آیین|اساسنامه|دستورالعمل|بخشنامه))", "")
    return F.btrim(x, F.lit(" -–|"))


def legal_title(x: Column | str) -> Column:
    """A title up to words on its approval or the verb."""
    return F.btrim(F.split(normalize_space(x), TITLE_END, 2)[0], F.lit(" ،؛.ـ-–"))


def title_candidate(x: Column | str) -> Column:
    """A normalised phrase up to the first stop word."""
    stop = r"(?U)\b(?:" + "|".join(TITLE_STOPS) + r")\b"
    return F.trim(F.split(normalize_law(x), stop, 2)[0])


def ruling_candidate(x: Column | str) -> Column:
    """The title in a ruling's phrase, normalised, up to the first stop word of rulings; round brackets stay."""
    stop = r"(?U)\b(?:" + "|".join(RULING_STOPS) + r")\b"
    return F.btrim(F.split(normalize_ruling(legal_title(x)), stop, 2)[0], F.lit(" ،؛."))


def safe_filename(x: Column | str, length: int = 120) -> Column:
    name = F.btrim(F.regexp_replace(normalize_space(x), r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(" ._"))
    name = F.when(name == "", F.lit("file")).otherwise(name)
    return F.rtrim(F.substring(name, 1, length), F.lit(" ._"))


def page_filename(x: Column | str) -> Column:
    return F.concat(F.regexp_replace(_c(x), r"[^a-zA-Z0-9_.-]+", "_"), F.lit(".html"))


def number_tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(normalize_digits(x), F.lit(r"(\d+)"), 1)


def legal_number_tokens(x: Column | str) -> Column:
    """Numbers with their repeat mark, as n_مکرر; number words up to ten as digits."""
    words = "|".join(NUMBER_WORDS)
    tokens = F.regexp_extract_all(normalize_digits(x), F.lit(rf"(\d+(?:\s*مکرر)?|{words})"), 1)
    table = F.create_map(*[F.lit(v) for kv in NUMBER_WORDS.items() for v in kv])
    # "۵مکرر" keeps no underscore, as there is no space to become one
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.replace(F.regexp_replace(t, r"\s+", " "), F.lit(" "), F.lit("_"))))


def decision_number_tokens(x: Column | str) -> Column:
    tokens = F.regexp_extract_all(normalize_digits(x), F.lit(r"((?:\(ر\)|ر)?\s*\d+(?:/\d+)?)"), 1)
    return F.transform(tokens, lambda t: F.replace(F.trim(t), F.lit(" "), F.lit("")))


def decision_key(x: Column | str) -> Column:
    return F.replace(F.replace(normalize_ruling(x), F.lit(" "), F.lit("")), F.lit("شماره"), F.lit(""))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return non_empty(F.regexp_extract(x, pattern, group))


def year(x: Column | str) -> Column:
    return _found(normalize_digits(x), r"(?:سال\s*)?(1[234]\d{2})")


def decision_number(title: Column | str) -> Column:
    raw = F.regexp_extract(or_empty(title), DECISION_NUMBER, 1)
    raw = F.btrim(normalize_space(normalize_digits(raw)), F.lit("-–،,؛. "))
    return non_empty(F.split(raw, DECISION_NUMBER_END, 2)[0])


def approval_date(x: Column | str) -> Column:
    return non_empty(F.regexp_replace(normalize_digits(F.regexp_extract(or_empty(x), DATE, 1)), r"\s+", ""))


def lines(x: Column | str) -> Column:
    return F.split(or_empty(x), r"\r\n|[\r\n]")


def subject(x: Column | str, longest: int = 700) -> Column:
    """The words after the subject label; the next line if the label stands alone; cut where the reasons begin if too long."""
    ls = lines(x)
    at = F.array_position(F.transform(ls, lambda l: l.rlike(SUBJECT_SAME)), F.lit(True))
    alone = F.array_position(F.transform(ls, lambda l: l.rlike(SUBJECT_ALONE)), F.lit(True))
    same = F.regexp_extract(F.try_element_at(ls, at.cast("int")), SUBJECT_VALUE, 1)
    following = F.try_element_at(ls, (alone + 1).cast("int"))
    s = normalize_space(F.when((at > 0) & ((alone == 0) | (at < alone)), same).when(alone > 0, following))
    rest = F.substr(s, F.lit(81))
    cut = F.when(rest.rlike(REASONS), F.trim(F.concat(F.substring(s, 1, 80), F.regexp_extract(rest, REASONS, 1))))
    short = F.coalesce(cut, F.concat(F.rtrim(F.substring(s, 1, longest)), F.lit("…")))
    return non_empty(F.when(F.length(s) > longest, short).otherwise(s))


def issuing_body(x: Column | str) -> Column:
    """A known institution in the text, in its usual spelling, else the words after the name of a general board."""
    n = normalize_ruling(x)
    known = F.coalesce(*[F.when(n.contains(normalize_ruling(F.lit(i))), F.lit(i.replace("هیات", "هیأت"))) for i in INSTITUTIONS])
    return F.coalesce(known, non_empty(normalize_space(F.regexp_extract(or_empty(x), GENERAL_BOARD, 1))))


def approval_line(x: Column | str) -> Column:
    """The first of eight lines with a word of approval, else the words around the first one."""
    ls = F.slice(lines(x), 1, 8)
    line = F.try_element_at(F.filter(ls, lambda l: l.rlike(APPROVAL_WORD)), F.lit(1))
    near = non_empty(F.regexp_extract(or_empty(x), APPROVAL_NEAR, 1))
    return F.when(F.coalesce(line, near).isNotNull(), normalize_space(F.coalesce(line, near)))


def label_value(strings: Column | str, labels: list[str], stops: list[str], reach: int = 4) -> Column:
    """The value after a label in an array of strings: in the same string, or the next within reach that is no label."""
    strings = _c(strings)
    clean = F.transform(strings, normalize_profile)
    wanted = F.array(*[F.lit(x) for x in labels])
    other = F.array(*[F.lit(x) for x in [*labels, *stops]])
    at = F.array_position(F.transform(clean, lambda s: F.array_contains(wanted, s)), F.lit(True)).cast("int")
    after = F.slice(clean, F.greatest(at, F.lit(0)) + 1, reach)
    before_stop = F.coalesce(F.nullif(F.array_position(F.transform(after, lambda s: F.array_contains(other, s)), F.lit(True)), F.lit(0)) - 1, F.lit(reach))
    following = F.try_element_at(F.filter(F.slice(after, F.lit(1), before_stop.cast("int")), lambda s: s != ""), F.lit(1))
    same = F.regexp_extract(F.try_element_at(F.filter(clean, lambda s: s.rlike(rf"^(?:{'|'.join(labels)})\s*[:：]?\s+\S")), F.lit(1)), rf"^(?:{'|'.join(labels)})\s*[:：]?\s+(.*)$", 1)
    return F.coalesce(F.when(at > 0, following), non_empty(same))


def email(x: Column | str) -> Column:
    return _found(or_empty(x), f"({EMAIL})", 0)


def _relation(normal: Column, kinds: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    return F.coalesce(*[F.when(normal.rlike(words), kind) for words, kind in kinds], F.lit(otherwise))


def law_relation(context: Column | str) -> Column:
    return _relation(normalize_law(context), LAW_RELATIONS, "REFERENCES")


def ruling_relation(context: Column | str) -> Column:
    return _relation(normalize_ruling(context), RULING_RELATIONS, "REFERENCES")


def decision_relation(context: Column | str) -> Column:
    return _relation(normalize_ruling(context), DECISION_RELATIONS, "CITES_DECISION")


def hop_score(hops: Column | str) -> Column:
    return F.lit(1.0) / (1 + F.greatest(_c(hops), F.lit(1)))


def clip(x: Column | str, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n)), F.lit("…"))).otherwise(_c(x))


def excerpt(x: Column | str, n: int = 280) -> Column:
    return F.substring(normalize_space(x), 1, n)


def string_list(x: Column | str) -> Column:
    """Trimmed members that are neither NULL nor blank; NULL gives an empty list."""
    cleaned = F.filter(F.transform(F.array_compact(_c(x)), lambda v: F.trim(v)), lambda v: v != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def json_list(x: Column | str) -> Column:
    """Members of a JSON list of strings; an empty list if the JSON is bad or NULL."""
    return F.coalesce(F.from_json(_c(x), "array<string>"), F.array().cast("array<string>"))


def literal_object(x: Column | str) -> Column:
    """Keys and literals of a script object, as a map; later keys win over earlier ones."""
    pair = r"""["']?([A-Za-z_$][\w$]*)["']?\s*:\s*(?:"([^"]*)"|'([^']*)'|(-?\d+(?:\.\d+)?|true|false|null))"""
    keys = F.regexp_extract_all(or_empty(x), F.lit(pair), 1)
    values = [F.regexp_extract_all(or_empty(x), F.lit(pair), i) for i in (2, 3, 4)]
    entries = F.transform(F.arrays_zip(keys, *values), lambda e: F.struct(e["0"].alias("k"), F.concat(e["1"], e["2"], e["3"]).alias("v")))
    last = F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))),
    )
    return last


def header_map(x: Column | str) -> Column:
    """Pairs of a header of the form k=v; k2=v2; the first = divides, blanks are trimmed."""
    parts = F.filter(F.transform(F.split(or_empty(x), ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    return F.map_from_arrays(
        F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"^([^=]*)=", 1))), F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))
    )


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def env_flag(value: str | None) -> bool:
    return (value or "").strip().lower() in {"1", "true", "yes", "on"}


def paywalled(x: Column | str) -> Column:
    """Two distinct offers of a subscription, and no date or subject of a ruling."""
    t = or_empty(x)
    offers = sum((t.contains(m).cast("int") for m in PAYWALL_MARKERS), F.lit(0))
    return (offers >= 2) & ~(t.rlike(DATE) | t.rlike("موضوع ?:"))


def file_access(page: Column | str, has_file: Column, authenticated: Column) -> Column:
    n = normalize_file(page)
    any_of = lambda ms: n.rlike("|".join(ms))
    return (
        F.when(any_of(LOGIN_MARKERS), "unauthorized")
        .when(any_of(PAYWALL_MARKERS) & ~has_file, "paywalled")
        .when(has_file & authenticated, "subscribed")
        .when(has_file, "public")
        .otherwise("missing_file")
    )


def looks_missing(status: Column, title: Column | str, content: Column | str) -> Column:
    t, c = F.lower(normalize_space(title)), F.lower(normalize_space(content))
    short = (F.length(c) < 500) & c.rlike("page not found|صفحه مورد نظر یافت نشد|اطلاعاتی یافت نشد|موردی یافت نشد")
    return F.coalesce(status == 404, F.lit(False)) | t.rlike("404|not found|صفحه یافت نشد|صفحه مورد نظر یافت نشد") | short


def markers(x: Column | str) -> Column:
    """Source ids that a text cites, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(or_empty(x), F.lit(MARKER), 1))


def strip_markers(x: Column | str, valid: Column) -> Column:
    """The text without the markers whose ids aren't valid."""
    bad = F.array_except(markers(x), valid)
    return F.trim(F.aggregate(bad, or_empty(x), lambda t, b: F.replace(t, F.concat(F.lit("["), b, F.lit("]")), F.lit(""))))
