"""Problem 1: personal information inside free text.

E-mail addresses, phone numbers, identity numbers and street addresses have forms and are read from them. Names have
none, so the corpus says which words name somebody (information-theoretic sanitisation): for each word t its disclosure
is the information that t gives about the event "a person is named here", log2(P(named | t) / P(named)), estimated from
co-occurrence in all texts: with honorifics, with frames of self-introduction, and with the names of a register. Words
that leave at most ``MOST_DOUBT`` bits of doubt about it disclose an entity; a family name with a given name or honorific
is generalised to a placeholder.

Words are looked up exactly: a scan marks the words that a bitmap of fixed size may hold, next to each other as names
stand, and a join by hash with all disclosing words keeps the true ones. Matching runs on a copy of the text in consistent
form whose offsets lead back to the original, so all else in the text stays as it is. NULL stays NULL and '' stays '';
both have no item. Texts are read whole; repeated rows are treated alike, whatever their keys.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bitmaps import bitmap_of, members
from .confusables import _INVISIBLE, LATIN_OF, PERSIAN, _ordinary

TYPES = ("email", "phone", "identity_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[IDENTITY_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Bits of doubt that a disclosing word may leave, -log2 P(a person is named | word), and the support of that estimate:
#: occurrences at the rate of all words that are added to its own.
MOST_DOUBT, SUPPORT = 1.32, 0.5

_DIGITS = {chr(0x6F0 + i): str(i) for i in range(10)} | {chr(0x660 + i): str(i) for i in range(10)}
_ASCII = str.maketrans(_DIGITS)
_FOLD = PERSIAN | _DIGITS
_FOREIGN_RUN = re.compile(r"[A-Za-zͰ-ϿЀ-ԯ]+")

# Titles before a family name.
HONORIFICS = frozenset("آقای اقای آقا خانم جناب سرکار دکتر مهندس استاد حاج mr mrs ms dr miss".split())
_FRAME = re.compile(r"(?i:\bname is|\bsigned by|\bi am|\bthis is)\s+([A-Z][\w'-]+)\s+([A-Z][\w'-]+)")
# Digits as words.
_DIGIT_WORDS = dict(zip("صفر یک دو سه چهار پنج شش هفت هشت نه".split(), "0123456789")) | dict(
    zip("zero one two three four five six seven eight nine".split(), "0123456789")
)
_SPOKEN = re.compile(rf"(?<!\w)(?:(?:{'|'.join(_DIGIT_WORDS)})[\s،,-]+){{9,}}(?:{'|'.join(_DIGIT_WORDS)})(?!\w)", re.I)
_AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|ات)\s?[\])]\s?|\s(?:at|ات)\s)"
_DOT = r"(?:\s?[\[(]\s?(?:\.|dot|نقطه)\s?[\])]\s?|\s?\.\s?(?=[A-Za-z])|\s(?:dot|نقطه)\s)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,}}(?![\w])", re.I)
_MAIL_HINT = re.compile(r"@|[\[(]\s?(?:at|ات)\s?[\])]|\s(?:at|ات) [A-Za-z0-9-]+(?:\.| dot |\[| \.| نقطه )", re.I)
_NUMBERS = re.compile(r"[+(]{0,2}\d[\d\s()\-–.]{6,}\d")
_G = r"[\s()\-–.]{0,2}"
_PHONE = re.compile(
    rf"(?<![\d+])(?:(?:\+|00){_G}98{_G}|\(?0)(?:9(?:{_G}\d){{9}}|[1-8]{_G}\d(?:{_G}\d){{8}})(?!\d)|(?<!\d)\d{{4}}[\s-]?\d{{4}}-0[1-8]\d(?!\d)"
)
_IDENTITY = re.compile(r"(?<![\d+])\d(?:[\s\-–.]?\d){9}(?!\d)")
# Words before numbers of files, receipts and payments.
_NOT_PERSONAL = re.compile(
    r"(?:واریز|رهگیری|قبض|رسید|پرونده|بایگانی|پیگیری|حساب|فیش|سند|ارجاع|تراکنش|مرجع|کارت|شبا|(?i:receipt|tracking|payment|file|reference|invoice|case|account|deposit|docket))(?:\s+(?:شماره|به شماره|(?i:no\.?|number|id|code)))?\s*[:：#]?\s*$"
)
_NAME_PART = r"[^\s،,.؛:؟!\n\d]+(?: [^\s،,.؛:؟!\n\d]+){0,2}"
_C = r"\s?[،,]\s?"
_NO = r"(?:پلاک|پ|شماره|ش)\.?\s?\d{1,5}"
_ROAD = r"(?:خیابان|خ|بلوار|بل|میدان|م|کوچه|ک|بزرگراه|اتوبان|جاده|بن‌بست|بن بست)\.?"
_MORE = r"(?:(?:طبقه|ط|واحد|و|بلوک|پلاک|پ|زنگ)\.?\s?\d{1,5}|(?:کد\s?‌?پستی|کدپستی)\s?:?\s?\d{5}[\s-]?\d{5}|صندوق پستی\s?\d+)"
_PLACE = rf"(?:(?:ابتدای|انتهای|نبش|جنب|روبروی|ساختمان|مجتمع|برج) {_NAME_PART}|{_ROAD} {_NAME_PART}|{_MORE})"
_START, _PART = re.compile(rf"(?<!\w){_ROAD} {_NAME_PART}"), re.compile(_C + _PLACE)
_HOUSE, _AFTER, _HOUSE_HINT = re.compile(rf"{_C}{_NO}(?!\d)"), re.compile(rf"{_C}{_MORE}(?!\d)"), re.compile(_NO)
_CITY_BEFORE = re.compile(r"(?:^|[\s:：])((?:شهرک |شهر |بندر )?[^\s،,.؛:؟!\d]+)\s?[،,]\s?$")
_NOT_CITY = frozenset("ساکن ملک در به از آدرس نشانی دفتر است".split())
_STREET_EN = r"(?:Street|St|Alley|Avenue|Ave|Road|Rd|Boulevard|Blvd|Square|Lane)\.?"
_ADDRESS_EN = re.compile(
    rf"(?:\bNo\.?\s?)?\b\d{{1,5}}{_C}(?:[A-Z][\w'-]+ ){{1,3}}{_STREET_EN}(?:{_C}(?:[A-Z][\w'-]+ ){{1,3}}{_STREET_EN})*(?:{_C}(?:[Uu]nit|[Ff]loor|[Ff]lat) \d+)?(?:{_C}(?!I\b)[A-Z][\w'-]+(?: [A-Z][\w'-]+)?)?(?:{_C}(?i:post(?:al)? ?code|postcode|zip)?\s?\d{{5}}-?\d{{5}})?"
)
_STREET_HINT = re.compile(_STREET_EN)
_NAME_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ً-ٰٕ‌'-](?=[^\W\d_])|[ً-ٕ])*")
_LOOSE = re.compile("[ً-ٰٕ‌'-]")


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The text for matching: letters in consistent form, digits ASCII; and of each character its place, None for the same."""
    if _ordinary(text):
        return text.translate(_ASCII) if not text.isascii() else text, None
    out: list[str] = []
    place: list[int] = []
    for i, c in enumerate(text):
        if c in _FOLD:
            c = _FOLD[c]
        elif not (" " <= c <= "~") and not ("آ" <= c <= "ۿ"):
            if _INVISIBLE.match(c):
                continue
            c = "".join(_FOLD.get(x, x) for x in unicodedata.normalize("NFKC", c))
            if c.isspace() and c not in "\r\n":
                c = " "
        for x in c:
            out.append(x)
            place.append(i)
    s = "".join(out)

    def latin(m: re.Match[str]) -> str:
        w = m[0]
        return w if w.isascii() or not any(x.isascii() for x in w) else "".join(LATIN_OF.get(x, x) for x in w)

    return _FOREIGN_RUN.sub(latin, s), place


def identity_number(digits: str) -> bool:
    """Ten digits, not all the same, whose last is right."""
    if len(digits) != 10 or len(set(digits)) == 1:
        return False
    r = sum(int(d) * (10 - i) for i, d in enumerate(digits[:9])) % 11
    return int(digits[9]) == (r if r < 2 else 11 - r)


def name_key(w: str) -> int:
    return xxhash.xxh3_64_intdigest(_LOOSE.sub("", w).lower())


def _word_kind(known: Callable[[int], int]) -> Callable[[str], int]:
    """The kind of a word: 1 given name, 2 family name, 4 addition, or 8 honorific; from 256 on, how many digits it says."""
    kept: dict[str, int] = {}

    def kind(w: str) -> int:
        k = kept.get(w)
        if k is None:
            if len(kept) > 1 << 17:
                kept.clear()
            if w.lower() in HONORIFICS:
                k = 8
            elif w.isascii() and not w[:1].isupper():
                k = 0
            else:
                k = known(name_key(w))
            kept[w] = k = k + 256 * sum(x in _DIGIT_WORDS for x in w.lower().split("-"))
        return k

    return kind


def exact(words: dict[int, int]) -> Callable[[str], int]:
    """Kinds from a dictionary of word hashes."""
    return _word_kind(lambda h: words.get(h, 0))


def _maybe(maps: tuple[np.ndarray, ...]) -> Callable[[str], int]:
    """Kinds that a word may have by bitmaps."""
    return _word_kind(lambda h: sum(1 << i for i, m in enumerate(maps) if members(m, np.array([h], np.uint64))[0]))


class Lexicon:
    """Words that disclose a person: the exact table (h, kinds), and bitmaps of given names, family names and additions
    that pass all of its words and some others."""

    def __init__(self, words: DataFrame | None, maps: tuple[np.ndarray, ...]):
        self.words, self.maps = words, maps

    def prefilter(self) -> Callable[[str], int]:
        return _maybe(self.maps)


#: A word that may belong to a name: its number among the words, span, kind, hash, and what stands before the next word
#: (2 a space, 1 spaces and full stops, 0 anything else).
Token = tuple[int, int, int, int, int, int]


def tokens(s: str, kind: Callable[[str], int]) -> tuple[list[Token], int]:
    """Neighbouring words that may make a name, and how many digits are said in words."""
    kinds = [kind(w) for w in _NAME_WORD.findall(s)]
    said = sum(k >> 8 for k in kinds)
    if not any(k & 2 for k in kinds):
        return [], said
    spots = [m.span() for m in _NAME_WORD.finditer(s)] + [(len(s), len(s))]
    out: list[Token] = []
    run: list[Token] = []
    for i, k in enumerate(kinds):
        if k & 15:
            a, b = spots[i]
            between = s[b : spots[i + 1][0]]
            gap = 2 if between == " " else int(i + 1 < len(kinds) and between.strip(" .") == "")
            run.append((i, a, b, k & 15, 0 if k & 8 else name_key(s[a:b]), gap))
            if gap:
                continue
        if any(t[3] & 2 for t in run[1:]):
            out += run
        run = []
    if any(t[3] & 2 for t in run[1:]):
        out += run
    return out, said


def names(found: list[Token]) -> list[tuple[int, int]]:
    """Spans of a family name with a given name or honorific before it, and an addition after it."""
    at = {t[0]: t for t in found}
    is_ = lambda i, bit, gap: i in at and at[i][3] & bit and at[i][5] >= gap
    out = []
    for i, (_, _, end, k, _, gap) in at.items():
        if not k & 2:
            continue
        first = i - 1 if is_(i - 1, 1, 1) else i
        while is_(first - 1, 8, 1):
            first -= 1
        if first != i:
            out.append((at[first][1], at[i + 1][2] if gap == 2 and is_(i + 1, 4, 0) else end))
    return out


def _lead(s: str, a: int, words: int = 5) -> str:
    """The text before a: at least so many words."""
    size = 64
    while size < a and len(s[a - size : a].split()) <= words:
        size *= 4
    return s[max(0, a - size) : a]


def addresses(s: str) -> Iterator[tuple[int, int]]:
    """A road, any further places after commas, a house number, and what follows it."""
    at = 0
    while m := _START.search(s, at):
        end = last = m.end()
        while not (house := _HOUSE.match(s, end)) and (part := _PART.match(s, end)):
            last, end = end, part.end()
        if house:
            end = house.end()
            while more := _AFTER.match(s, end):
                end = more.end()
            a, city = m.start(), _CITY_BEFORE.search(_lead(s, m.start()))
            if city and city[1].split()[-1] not in _NOT_CITY:
                a -= len(city.string) - city.start(1)
            yield a, end
            at = end
        else:  # no number after these places: another road may begin in the last of them
            at = m.start() + 1 if last == m.end() else last


def forms(s: str, said: int) -> list[tuple[int, int, str]]:
    """(start, end, type) of each item that has a form; said: digits said in words."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in found):
            found.append((a, b, kind))

    if _HOUSE_HINT.search(s):
        for a, b in addresses(s):
            add(a, b, "address")
    if _STREET_HINT.search(s):
        for m in _ADDRESS_EN.finditer(s):
            add(*m.span(), "address")
    if _MAIL_HINT.search(s):
        for m in _EMAIL.finditer(s):
            if s[max(0, m.start() - 3) : m.start()] != "://":
                add(*m.span(), "email")
    for m in _NUMBERS.finditer(s):
        for p in _PHONE.finditer(s, *m.span()):
            if not _NOT_PERSONAL.search(_lead(s, p.start())):
                add(*p.span(), "phone")
        for p in _IDENTITY.finditer(s, *m.span()):
            if identity_number(re.sub(r"\D", "", p[0])) and not _NOT_PERSONAL.search(_lead(s, p.start())):
                add(*p.span(), "identity_number")
    if said >= 10:
        for m in _SPOKEN.finditer(s):
            words = list(re.finditer(r"\w+", m[0]))
            digits = "".join(_DIGIT_WORDS[w[0].lower()] for w in words)
            phone = re.match(r"(?:0098|98|0)[1-9]\d{9}", digits)  # a word after it may be a number of its own
            n = phone.end() if phone else 10 if identity_number(digits[:10]) else 0
            if n:
                add(m.start(), m.start() + words[n - 1].end(), "phone" if phone else "identity_number")
    return found


def with_names(found: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Items in text order; names that overlap another item are left out."""
    out = list(found)
    for a, b in spans:
        if not any(a < y and x < b for x, y, _ in out):
            out.append((a, b, "name"))
    return sorted(out)


def items(text: str, kind: Callable[[str], int]) -> list[tuple[int, int, str]]:
    """(start, end, type) of each item in text order, as offsets in the original; items don't overlap."""
    s, place = aligned(text)
    found, said = tokens(s, kind)
    out = with_names(forms(s, said), names(found))
    return out if place is None else [(place[a], place[b - 1] + 1, t) for a, b, t in out]


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


_COUNTS = pa.schema([("h", pa.int64()), ("given", pa.int64()), ("family", pa.int64()), ("addition", pa.int64()), ("n", pa.int64())])
_COUNTS_DDL = "h long, given long, family long, addition long, n long"


def _count_batch(n: Counter, slots: tuple[Counter, Counter, Counter]) -> pa.RecordBatch:
    by_key: dict[int, list[int]] = {}
    for c, at in ((n, 3), (slots[0], 0), (slots[1], 1), (slots[2], 2)):
        for w, k in c.items():
            by_key.setdefault(name_key(w), [0, 0, 0, 0])[at] += k
    h = np.array(list(by_key), np.uint64).view(np.int64)
    columns = list(zip(*by_key.values())) if by_key else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(c, pa.int64()) for c in columns]], schema=_COUNTS)


def _register(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of a register: given, family, additions, by place."""
    for part in parts:
        n, slots = Counter(), (Counter(), Counter(), Counter())
        for name in part.column(0).to_pylist():
            ws = [w for w in _NAME_WORD.findall(aligned(name)[0]) if w.lower() not in HONORIFICS]
            if len(ws) > 1:
                n.update(ws)
                slots[0][ws[0]] += 1
                slots[1][ws[1]] += 1
                slots[2].update(ws[2:])
        yield _count_batch(n, slots)


_PAIRS = pa.schema([("a", pa.int64()), ("h", pa.int64()), ("given", pa.int64()), ("family", pa.int64()), ("n", pa.int64())])
_PAIRS_DDL = "a long, h long, given long, family long, n long"


def _co_occurrence(maps: tuple[np.ndarray, ...]):
    """Counts of words (a is NULL; given and family by frames of introduction), and of neighbours (a, h) whose first word
    may be a given name; a is 0 for an honorific."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _maybe(maps)
        for part in parts:
            n: Counter = Counter()
            frames: tuple[Counter, Counter] = Counter(), Counter()
            pairs: Counter = Counter()
            for text in part.column(0).to_pylist():
                s = aligned(text)[0]
                if _MAIL_HINT.search(s):
                    s = _EMAIL.sub(" ", s)
                ws = _NAME_WORD.findall(s)
                n.update(w for w in ws if not w.isascii() or w.istitle())
                kinds = [kind(w) for w in ws]
                for i, k in enumerate(kinds[:-1]):
                    if k & 9 and not kinds[i + 1] & 8:
                        pairs[None if k & 8 else ws[i], ws[i + 1]] += 1
                if "name" in s or "signed by" in s or "I am" in s:
                    for a, b in _FRAME.findall(s):
                        frames[0][a] += 1
                        frames[1][b] += 1
            by_key: dict[tuple[int | None, int], list[int]] = {}
            for c, at in ((frames[0], 0), (frames[1], 1), (n, 2)):
                for w, k in c.items():
                    by_key.setdefault((None, name_key(w)), [0, 0, 0])[at] += k
            for (a, b), k in pairs.items():
                by_key.setdefault((name_key(a) if a else 0, name_key(b)), [0, 0, 0])[2] += k
            signed = lambda h: None if h is None else h - (1 << 64) if h >> 63 else h
            rows = [(signed(a), signed(h), *v) for (a, h), v in by_key.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _PAIRS)], schema=_PAIRS)

    return run


def disclosure(texts: DataFrame, register: DataFrame) -> DataFrame:
    """(h, given, family, addition, n, share, bits, doubt) of each word: counts over all texts and the register.

    texts and register have one string column. A given name stands before a registered family name; a family name after a
    registered given name or an honorific. share is P(a person is named | word), bits the information of the word about
    that, doubt what is left of it.
    """
    known = register.where(F.length(register.columns[0]) > 0).mapInArrow(_register, _COUNTS_DDL).groupBy("h")
    known = written(known.agg(*[F.sum(c).alias(c) for c in ("given", "family", "addition", "n")]), "register")
    maps = tuple(bitmap_of(known.where(F.col(c) > 0).select("h")) for c in ("given", "family"))
    rows = texts.where(F.length(texts.columns[0]) > 0).mapInArrow(_co_occurrence(maps), _PAIRS_DDL)
    rows = written(rows.groupBy("a", "h").agg(*[F.sum(c).alias(c) for c in ("given", "family", "n")]), "neighbours")
    words = rows.where("a IS NULL").select("h", "given", "family", F.lit(0).cast("long").alias("addition"), "n")
    role = lambda h, *names: known.select(F.col("h").alias(h), *[(F.col(n) > 0).alias(f"{h}_{n}") for n in names])
    pairs = rows.where("a IS NOT NULL").select("a", F.col("h").alias("b"), "n").join(role("a", "given"), "a", "left").join(role("b", "given", "family"), "b", "left").na.fill(False)
    slot = lambda df, h, given, family: df.select(F.col(h).alias("h"), *[(F.col("n") if x else F.lit(0).cast("long")).alias(c) for c, x in (("given", given), ("family", family), ("addition", 0), ("n", 0))])
    families = slot(pairs.where("(a = 0 OR a_given) AND NOT b_given"), "b", 0, 1)
    givens = slot(pairs.where("a_given AND b_family"), "a", 1, 0)
    words = known.unionByName(words).unionByName(families).unionByName(givens).groupBy("h").agg(*[F.sum(c).alias(c) for c in ("given", "family", "addition", "n")])
    words = written(words, "disclosure")
    total = words.agg(F.sum("family"), F.sum("n")).first()
    base = max(1, total[0] or 0) / max(1, total[1] or 0)
    likely = lambda c: F.least((c + SUPPORT * base) / (F.col("n") + SUPPORT), F.lit(1.0))
    share = likely(F.greatest("given", "family", "addition"))
    roles = reduce(lambda x, y: x + y, [F.when((F.col(c) > 0) & (-F.log2(likely(F.col(c))) <= MOST_DOUBT), 1 << i).otherwise(0) for i, c in enumerate(("given", "family", "addition"))])
    return words.select("*", share.alias("share"), F.log2(share / base).alias("bits"), (-F.log2(share)).alias("doubt"), roles.alias("kinds"))


def learn(texts: DataFrame, register: DataFrame) -> Lexicon:
    """The words over the threshold, written; three bitmaps of fixed size reach the driver."""
    words = written(disclosure(texts, register).where("kinds > 0").select("h", "kinds"), "names")
    return Lexicon(words, tuple(bitmap_of(words.where(F.col("kinds").bitwiseAND(1 << i) > 0).select("h")) for i in range(3)))


_SPANS = [("u", pa.int64()), ("type", pa.string()), *[(n, pa.int32()) for n in ("i", "start", "end", "kind", "gap")], ("h", pa.int64())]
_SPANS_DDL = "u long, type string, i int, start int, end int, kind int, gap int, h long"
_ITEMS = [("pii_type", pa.string()), ("occurrence", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
_ITEMS_DDL = "pii_type string, occurrence int, start int, end int"


def _carried(part: pa.RecordBatch, keys: list[str], at: list[int], rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    """Rows beside the keys of the batch's rows that they come from."""
    columns = zip(*rows) if rows else [[]] * len(fields)
    kept = [part.column(k).take(pa.array(at, pa.int64())) for k in keys]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], names=[*keys, *[n for n, _ in fields]])


def _scan(maps: tuple[np.ndarray, ...], keys: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _maybe(maps)
        for part in parts:
            rows: list[tuple] = []
            at: list[int] = []
            for n, (u, text) in enumerate(zip(part.column("u").to_pylist(), part.column("t").to_pylist())):
                s, place = aligned(text)
                spot = (lambda a, b: (a, b)) if place is None else (lambda a, b: (place[a], place[b - 1] + 1))
                found, said = tokens(s, kind)
                rows += [(u, t, 0, *spot(a, b), 0, 0, None) for a, b, t in forms(s, said)]
                rows += [(u, None, i, *spot(a, b), k, gap, None if k & 8 else h - (1 << 64) if h >> 63 else h) for i, a, b, k, h, gap in found]
                at += [n] * (len(rows) - len(at))
            yield _carried(part, keys, at, rows, _SPANS)

    return run


def _item_rows(keys: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            at: list[int] = []
            for n, spans in enumerate(part.column("spans").to_pylist()):
                found = [(x["start"], x["end"], x["type"]) for x in spans if x["type"]]
                words = sorted((x["i"], x["start"], x["end"], x["kind"], 0, x["gap"]) for x in spans if not x["type"])
                seen: Counter = Counter()
                for a, b, t in with_names(found, names(words)):
                    seen[t] += 1
                    rows.append((t, seen[t], a, b))
                at += [n] * (len(rows) - len(at))
            yield _carried(part, keys, at, rows, _ITEMS)

    return run


def _items(texts: DataFrame, keys: list[str], lexicon: Lexicon) -> DataFrame:
    """The keys, pii_type, occurrence, start, end of texts (u, t and keys). u may be a number that is drawn anew with every
    run: the marks that carry it are written before they are grouped."""
    kinds = ", ".join(f"{k} {dict(texts.dtypes)[k]}" for k in keys)
    spans = texts.where(F.length("t") > 0).mapInArrow(_scan(lexicon.maps, keys), f"{kinds}, {_SPANS_DDL}")
    spans = written(spans, "spans")
    true = spans.where("h IS NOT NULL").join(lexicon.words, "h").withColumn("kind", F.col("kinds")).select(*spans.columns)
    whole = spans.where("h IS NULL").unionByName(true)
    whole = whole.groupBy("u").agg(*[F.first(k).alias(k) for k in keys], F.collect_list(F.struct("type", "i", "start", "end", "kind", "gap")).alias("spans"))
    return whole.mapInArrow(_item_rows(keys), f"{kinds}, {_ITEMS_DDL}")


def found_items(df: DataFrame, key: str | list[str], field: str, lexicon: Lexicon) -> DataFrame:
    """(the key columns, pii_type, occurrence, start, end): occurrence counts 1, 2, … in text order among items of a type in a
    value. Each row of df counts for itself, whatever its keys."""
    names_ = [key] if isinstance(key, str) else key
    keys = [f"k{i}" for i in range(len(names_))]
    texts = df.select(*[F.col(n).alias(k) for n, k in zip(names_, keys)], F.monotonically_increasing_id().alias("u"), F.col(field).alias("t"))
    return _items(texts, keys, lexicon).withColumnsRenamed(dict(zip(keys, names_)))


def redacted(df: DataFrame, fields: list[str], lexicon: Lexicon) -> DataFrame:
    """The table with a typed placeholder for each item in the fields."""
    u = "_u"
    while u in df.columns:
        u += "_"
    out = base = written(df.withColumn(u, F.monotonically_increasing_id()), "texts")

    @F.arrow_udf("string")
    def replace(values: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [replaced(t, sorted((x["start"], x["end"], x["pii_type"]) for x in s)) if t and s else t for t, s in zip(values.to_pylist(), spans.to_pylist())]
        return pa.array(rows, pa.string())

    for f in fields:
        texts = base.select(F.col(u).alias("u"), F.col(u).alias("k"), F.col(f).alias("t"))
        spans = _items(texts, ["k"], lexicon).groupBy("k").agg(F.collect_list(F.struct("start", "end", "pii_type")).alias("spans"))
        out = out.join(spans.withColumnsRenamed({"k": u, "spans": u + f}), u, "left").withColumn(f, replace(F.col(f), F.col(u + f))).drop(u + f)
    return out.select(*df.columns)
