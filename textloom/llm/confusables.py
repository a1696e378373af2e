"""Problem 6: one consistent form for text that looks the same.

``skeleton`` follows the confusables method: decompose, replace each character by the prototype of its look-alike class,
decompose again. Originals with one skeleton form one group. ``consistent`` is the readable member of such a group that
the corpus keeps: the same look-alike table, but composed letters, plain spaces, and foreign letters changed only inside
words that mix scripts.

Defined results: NULL stays NULL, '' stays ''; both functions are idempotent; rows that are repeated stay repeated;
texts of any length are treated whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Letters that look like a Latin letter, and the Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜҮӀасԁеһіјӏорԛѕԝхуѵү", "ABESIJKMHOPCTYXQWYIacdehijlopqswxyvy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιορυκ", "ABEZHIKMNOPTYXaviopuk"))
ARMENIAN = dict(zip("ՍՏՕԼոսցհօզ", "USOLnughoq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
# Latin letters of another shape that are read as a basic one; only skeletons change them.
LATIN = dict(zip("ɑɡɩıʋ", "agiiu"))
# Arabic letters that stand for a usual Persian letter of the same shape.
PERSIAN = {"ي": "ی", "ى": "ی", "ك": "ک", "ڪ": "ک", "ە": "ه", "ہ": "ه", "ھ": "ه"}

LATIN_OF = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU
#: Ranges of the scripts whose letters may look Latin, and the letter of the script for a Latin one.
_SCRIPTS = [(a, b, {y: x for x, y in reversed(t.items())}) for a, b, t in (
    ("Ͱ", "Ͽ", GREEK), ("Ѐ", "ԯ", CYRILLIC), ("Ա", "֏", ARMENIAN), ("Ꭰ", "ᏽ", CHEROKEE), ("Ⲁ", "⳿", COPTIC), ("ꓐ", "꓿", LISU),
)]
_ARABIC_DIGITS = {chr(0x660 + i): chr(0x6F0 + i) for i in range(10)}
_PLAIN = str.maketrans(PERSIAN | _ARABIC_DIGITS | {"\t": " "})
_PROTOTYPE = str.maketrans(LATIN_OF | LATIN | PERSIAN | _ARABIC_DIGITS | {"\t": " ", "‌": None})
#: Default-ignorable and control characters, without U+200C and line breaks.
_INVISIBLE = re.compile(
    "[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f­͏؜ᅟᅠ឴឵᠋-᠏​‍-‏‪-‮"
    "⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_SPACES = re.compile("[   -   　]")
_JOINS = re.compile("‌+")
_LOOSE_JOIN = re.compile("(?<![؀-ۿ])‌|‌(?![؀-ۿ])")
_FOREIGN = re.compile("[" + "".join(f"{a}-{b}" for a, b, _ in _SCRIPTS) + "]")
_RUN = re.compile(r"[^\W_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")

_ORDINARY = (
    "\n\r" + "".join(map(chr, range(0x20, 0x7F))) + "«»ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿĞğİıŞş"
    "،؛؟٪ءآأؤإئابةتثجحخدذرزسشصضطظعغفقلمنهوپچژکگی۰۱۲۳۴۵۶۷۸۹ً"
)
_is_ordinary = re.compile("[" + re.sub(r"([\[\]\\^&-])", r"\\\1", _ORDINARY) + "‌]*").fullmatch
#: For Java: where it finds nothing, a text is in consistent form already.
SUSPECT = "[^" + re.sub(r"([\[\]\\^&-])", r"\\\1", _ORDINARY) + "‌]|(?<![؀-ۿ])‌|‌(?![؀-ۿ])"


def _ordinary(text: str) -> bool:
    """Whether ``SUSPECT`` finds nothing."""
    if not _is_ordinary(text):
        return False
    if "‌" in text:
        parts = text.split("‌")
        return all(p and "؀" <= p[-1] <= "ۿ" for p in parts[:-1]) and all(p and "؀" <= p[0] <= "ۿ" for p in parts[1:])
    return True


def _one_script(match: re.Match[str]) -> str:
    word = match[0]
    foreign = _FOREIGN.findall(word)
    if not foreign or not _LATIN.search(word):
        return word
    own = [c for c in foreign if c not in LATIN_OF]
    if own:  # a foreign word with Latin letters in it
        back = next(t for a, b, t in _SCRIPTS if a <= own[0] <= b)
        return "".join(back.get(c, c) for c in word)
    return "".join(LATIN_OF.get(c, c) for c in word)


def consistent(text: str | None) -> str | None:
    """The consistent form of one text: changed until nothing changes, as a mark that joins its letter can join two words."""
    while text and not _ordinary(text) and (changed := _changed(text)) != text:
        text = changed
    return text


def _changed(text: str) -> str:
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    text = _INVISIBLE.sub("", _SPACES.sub(" ", text)).translate(_PLAIN).replace("یٔ", "ئ")
    text = unicodedata.normalize("NFC", text)
    if "‌" in text:
        text = _LOOSE_JOIN.sub("", _JOINS.sub("‌", text)).replace("یٔ", "ئ")
        text = unicodedata.normalize("NFC", text)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", _RUN.sub(_one_script, text))
    return text


def skeleton(text: str | None) -> str | None:
    """Equal for two texts that look the same, whatever characters they use."""
    if not text:
        return text
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _INVISIBLE.sub("", _SPACES.sub(" ", text)).translate(_PROTOTYPE)
        text = unicodedata.normalize("NFKD", text)
    return text.translate(_PROTOTYPE)


def _arrow(function):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([function(x) for x in column.to_pylist()], pa.string())

    return run


def consistent_column(column: Column | str) -> Column:
    """``consistent`` as an Arrow-batched column function."""
    f = _arrow(consistent)

    @F.arrow_udf(T.StringType())
    def consistent_form(values: pa.Array) -> pa.Array:
        return f(values)

    return consistent_form(column)


def skeleton_column(column: Column | str) -> Column:
    f = _arrow(skeleton)

    @F.arrow_udf(T.StringType())
    def confusables_skeleton(values: pa.Array) -> pa.Array:
        return f(values)

    return confusables_skeleton(column)


def _prototype(text: str) -> str:
    """The consistent form of a text if it looks the same, that is, if both have one skeleton; else the text."""
    form = consistent(text)
    return form if form != text and skeleton(form) == skeleton(text) else text


def inconsistent_values(df: DataFrame, key: str, fields: list[str], table_name: str) -> DataFrame:
    """(table_name, key, field_name, value, consistent_value) of every value that has the skeleton of its consistent form
    and differs from it.

    The pattern ``SUSPECT`` runs in the JVM, so a text made only of ordinary characters never reaches Python.
    NULL and '' have no row. Repeated rows come out as often as they are in.
    """
    long = df.select(
        F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("v")
    ).select(F.lit(table_name).alias("table_name"), key, "v.field_name", "v.value")
    form = long.where(F.col("value").rlike(SUSPECT)).withColumn("consistent_value", F.arrow_udf(_arrow(_prototype), T.StringType())("value"))
    return form.where(F.col("value") != F.col("consistent_value"))


def look_alike_members(values: DataFrame, value: str) -> DataFrame:
    """The rows with skeleton_hash instead of the value: a row for each value that isn't NULL, with the number of different
    originals and of rows that have its skeleton, n_forms and n_rows. Only hashes are shuffled; counts meet before that."""
    others = [c for c in values.columns if c != value]
    rows = values.where(F.col(value).isNotNull()).select(*others, F.md5(skeleton_column(value)).alias("skeleton_hash"), F.md5(value).alias("form"))
    rows = written(rows, "skeletons")
    forms = rows.groupBy("skeleton_hash", "form").agg(F.count("*").alias("n"))
    groups = forms.groupBy("skeleton_hash").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"))
    return rows.drop("form").join(groups, "skeleton_hash").select(*others, "skeleton_hash", "n_forms", "n_rows")


def look_alike_groups(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per skeleton of ``field``: skeleton_hash, consistent_value, n_forms (distinct originals), n_rows.

    Copies are counted per original before the shuffle by skeleton, so a value that holds a third of all rows is one
    row there. NULL is left out; '' is a group of its own. Groups with only one form are kept.
    """
    forms = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    hashed = forms.select(F.xxhash64(skeleton_column("value")).alias("skeleton_hash"), consistent_column("value").alias("c"), "n")
    return hashed.groupBy("skeleton_hash").agg(
        F.min("c").alias("consistent_value"), F.count("*").alias("n_forms"), F.sum("n").alias("n_rows")
    )


def batches(function, schema: pa.Schema):
    """A mapInArrow function from one that takes a batch's columns as lists and returns columns as lists."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = function(*[c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run
