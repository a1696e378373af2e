"""Problem 4: template residue, filler, error pages and script notices instead of content.

Normalised lines are counted by host. Lines that recur there and are no evidence themselves are boilerplate (menus,
footers, request numbers) and are subtracted from the records that hold evidence. A record is excluded if its residual
holds an unfilled placeholder, or if the rest of it is nothing but error messages, script notices and filler: a text that
merely discusses errors or scripts keeps other lines in its residual and stays.

One pass over the texts finds lines and evidence; only hashes of lines are counted. NULL and '' are never cases. Repeated
rows are judged alike, and copies of one text count once in the recurrence of its lines. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .confusables import consistent

# The real statuses.
NODE_STATUSES = ("public", "paywalled", "index", "entity", "reference_only", "linked_from_legal_db")
FILE_STATUSES = ("public", "subscribed", "paywalled", "unauthorized", "missing_file")

# Unfilled placeholders of template languages and forms, on lines as they stand.
PLACEHOLDER = re.compile("|".join((
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"\$\{[^{}]+\}", r"<%[^<>]*%>", r"\[\[[^\[\]]+\]\]", r"\{[A-Za-z_][A-Za-z_.]{2,}\}",
    r"(?<!\w)__[^\W\d_][\w. ]*?__(?!\w)",
    r"(?<![\w%])%[^\W\d_](?:[^\W\d]|[. ‌])*(?<=[^\W\d_])%(?![\w%])",
    r"[\[<][^\[\]<>]+را (?:وارد کنید|اینجا بنویسید|بنویسید)[\]>]",
    r"(?i:[\[<](?:insert|enter|your)\s[^\[\]<>]+[\]>])",
)))
_MAY_HOLD = re.compile(r"[{\[<%]|__")

# Fixed values, on normalised lines (lower case, numbers as #): what a line must hold, and the form that is evidence.
ERROR = (
    ("service", r"service (?:temporarily )?unavailable"), ("gateway", r"gateway time(?:d )?-?out|bad gateway"), ("internal server", r"internal server error"),
    ("error", r"^\W*(?:\w+\W+)?error:? #|(?:fatal|uncaught|parse|syntax|runtime) error|(?:^|\W)[a-z]\w*error:"), ("exception", r"(?:unhandled|uncaught) exception|(?:^|\W)[a-z]\w*exception:"),
    ("traceback", r"traceback\b"), ("stack trace", r"stack trace"), ("requested", r"requested (?:page|url|resource) (?:does not exist|was not found|could not be found)"),
    ("denied", r"(?:access|permission) (?:is |was )?denied"), ("too many", r"too many requests"), ("try again", r"(?:please )?try again (?:later|in)\b"),
    ("خطا", r"خطای? #+\s*:|^\W*خطای سرور\W*$|خطای داخلی سرور"), ("صفحه", r"صفحه(?: مورد نظر)? (?:یافت|پیدا) نشد"), ("سرور", r"سرور در حال حاضر پاسخگو نیست"),
    ("پایگاه", r"ارتباط با پایگاه داده برقرار نشد"), ("منقضی", r"نشست شما منقضی شده"), ("دسترسی", r"دسترسی شما (?:به این صفحه )?(?:مسدود|محدود) شده"),
    ("درخواست", r"درخواست\W{0,2}های شما بیش از حد مجاز"), ("<html", r"<html><body>#"),
)
SCRIPT = (
    ("<noscript", r"<noscript"),
    ("script", r"\b(?:enable|turn on|activate|requires?|needs?|need to enable|without)\b[^.]{0,60}(?:java)?scripts?\b"),
    ("script", r"(?:java)?scripts?\b[^.]{0,60}\b(?:is disabled|must be enabled|turn them on|is required|to run)\b"),
    ("اسکریپت", r"(?:جاوا\W?)?اسکریپت[^.]{0,60}(?:فعال کنید|روشن باش|روشن کنید|پشتیبانی نمی)|بدون فعال بودن (?:جاوا\W?)?اسکریپت"),
)
FILLER = (
    ("lorem", r"lorem ipsum"), ("dolor", r"dolor sit amet"), ("لورم", r"لورم ایپسوم"), ("متن", r"متن (?:نمونه|آزمایشی)|متن ساختگی(?: برای پر کردن صفحه)?|این متن جایگزین می.شود"),
    ("sample text", r"sample text(?: here)?"), ("asdf", r"asdf(?: qwer)?"), ("تست", r"تست تست"), ("محتوا", r"محتوا به.زودی"), ("placeholder", r"placeholder text"),
    ("your text", r"your text here"), ("todo", r"\btodo\b"), ("xxxx", r"x{4,}"),
)
#: Reason phrases of HTTP after a number, from the standard's own table.
_HTTP = tuple((s.phrase.lower(), rf"(?:^|\W)#\W*{re.escape(s.phrase.lower())}") for s in HTTPStatus if s >= 400)

#: A line recurs if at least LEAST_RECORDS different texts of the host hold it, and surely (by the lower end of the 95 %
#: interval) at least LEAST_SHARE of them do.
LEAST_SHARE, LEAST_RECORDS = 1 / 10_000, 3
#: The letters left of a line of filler after its filler phrases are taken out, as a share of all.
FILLER_REST = 0.3
#: The share of a line's letters in sentences with a message from which the line is evidence.
EVIDENCE_SHARE = 0.3

_NUMBER = re.compile(r"(?<![a-z0-9])[a-z]*[0-9][a-z0-9]*(?:-[0-9a-f]{4,})*|[۰-۹]+")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile(r"(?<=[.؟!?؛])\s+")


class Evidence:
    """All forms, behind one automaton over what they need."""

    def __init__(self) -> None:
        self.needs, self.forms = ahocorasick.Automaton(), {}
        for kind, forms in (("message", ERROR + SCRIPT + _HTTP), ("filler", FILLER)):
            for need, form in forms:
                self.needs.add_word(need, need)
                self.forms.setdefault((kind, need), []).append(form)
        self.needs.make_automaton()
        self.forms = {k: re.compile("|".join(v)) for k, v in self.forms.items()}

    def may(self, text: str) -> set[str]:
        return {need for _, need in self.needs.iter(text)}

    def __call__(self, line: str) -> bool:
        """Whether a normalised line is an error message, a script notice or filler."""
        needs = self.may(line)
        if not needs:
            return False
        all_ = len(_LETTER.findall(line)) or 1
        messages = [f for n in needs if (f := self.forms.get(("message", n)))]
        if any(f.search(line) for f in messages):
            told = [s for s in _SENTENCE.split(line) if any(f.search(s) for f in messages)]
            if not told or sum(len(_LETTER.findall(s)) for s in told) >= EVIDENCE_SHARE * all_:
                return True
        rest, fillers = line, [f for n in needs if (f := self.forms.get(("filler", n)))]
        for f in fillers:
            rest = f.sub("", rest)
        return rest != line and len(_LETTER.findall(rest)) <= FILLER_REST * all_


evidence = Evidence()


def normal_line(line: str) -> str:
    """Lower case, numbers and identifiers as #, single spaces."""
    return _SPACE.sub(" ", _NUMBER.sub("#", line.lower())).strip()


_SCHEMA = [("host", pa.string()), ("copy", pa.int64()), ("lines", pa.list_(pa.int64())), ("kinds", pa.binary())]
_DDL = "host string, copy long, lines array<long>, kinds binary"


def _lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: a hash of it, hashes of its distinct normalised lines, and of suspects what each line is: 0 ordinary,
    1 evidence, 2 a placeholder."""
    for part in parts:
        rows: list[tuple] = []
        for host, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            text = consistent(text)
            normal: dict[str, int] = {}
            for line in text.splitlines():
                n = normal_line(line)
                if n:
                    held = 2 if _MAY_HOLD.search(line) and PLACEHOLDER.search(line) else 0
                    normal[n] = max(held, normal.get(n, 0))
            if evidence.may("\n".join(normal)):
                normal = {n: held or int(evidence(n)) for n, held in normal.items()}
            kinds = bytes(normal.values()) if any(normal.values()) else None
            seed = xxhash.xxh3_64_intdigest(host)
            hashes = np.array([xxhash.xxh3_64_intdigest(n, seed) for n in normal], np.uint64).view(np.int64)
            rows.append((host, xxhash.xxh3_64_intdigest(text) - (1 << 63), hashes.tolist(), kinds))
        columns = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, _SCHEMA)]], names=["k", *[n for n, _ in _SCHEMA]])


def residue_texts(df: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """(key, reason) of the records whose text is a case: reason is placeholder or residue."""
    kind = dict(df.dtypes)[key]
    host = F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), host.alias("host"), F.col(text).alias("t"))
    rows = written(rows.mapInArrow(_lines, f"k {kind}, {_DDL}"), "lines")
    suspects = rows.where("kinds IS NOT NULL").select("k", "host", "lines", F.transform("lines", lambda _, i: F.ascii(F.substring(F.col("kinds").cast("string"), i + 1, 1))).alias("is"))
    suspects = suspects.select("k", "host", F.explode(F.arrays_zip("lines", "is")).alias("l")).select("k", "host", "l.lines", "l.is").withColumnRenamed("lines", "line")
    asked = suspects.where("`is` = 0").select("line").distinct()
    copies = rows.select("host", "copy", "lines").dropDuplicates(["host", "copy"])
    hosts = copies.groupBy("host").agg(F.count("*").alias("of"))
    counts = copies.select("host", F.explode("lines").alias("line")).join(asked, "line", "left_semi").groupBy("host", "line").agg(F.count("*").alias("n"))
    share, z2 = F.col("n") / F.col("of"), 1.96**2
    spread = 1.96 * F.sqrt(share * (1 - share) / F.col("of") + z2 / (4 * F.col("of") * F.col("of")))
    surely = (share + z2 / (2 * F.col("of")) - spread) / (1 + z2 / F.col("of"))
    recurrent = counts.where(F.col("n") >= LEAST_RECORDS).join(hosts, "host").where(surely >= LEAST_SHARE).select("line", F.lit(True).alias("boilerplate"))
    residual = suspects.join(recurrent, "line", "left").where("boilerplate IS NULL OR `is` > 0")
    judged = residual.groupBy("k").agg(F.max("is").alias("most"), F.min("is").alias("least")).where("most = 2 OR least > 0")
    return judged.select(F.col("k").alias(key), F.when(F.col("most") == 2, "placeholder").otherwise("residue").alias("reason"))


def bad_statuses(df: DataFrame, key: str, status: str, real: tuple[str, ...]) -> DataFrame:
    """(key, reason) of statuses that aren't among the real ones; NULL and blank ones aren't cases."""
    value = F.btrim(F.col(status), F.lit(" \t\r\n"))
    return df.where((value != "") & ~value.isin(*real)).select(key, F.lit("status").alias("reason"))


def without(df: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """The table without the rows that are cases; rows with a NULL key stay."""
    return df.join(cases.select(key).distinct(), key, "left_anti")
