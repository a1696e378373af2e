"""Deterministic identities as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_advice, or_empty, strip


def stable_id(prefix: str, value: Column | str) -> Column:
    """prefix: and 20 hex digits of SHA-1 of the trimmed, case-folded value."""
    v = F.lower(F.replace(strip(value), F.lit("ß"), F.lit("ss")))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(v.cast("binary")), 1, 20))


def relation_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def hash_id(prefix: str, value: Column | str, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.col(value) if isinstance(value, str) else value, 256), 1, digits))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The same as uuid.uuid5: SHA-1 of the namespace's bytes and the name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def article_id(document: Column, label: Column, number: Column) -> Column:
    return F.concat_ws(":", F.lit("article"), document, label, number)


def note_id(article: Column, number: Column, order: Column) -> Column:
    return F.concat_ws(":", F.lit("note"), article, F.coalesce(number, order.cast("string")))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", document, F.lit("chunk"), index.cast("string"), F.substring(F.sha2(text, 256), 1, 16))


def file_id(own: Column, url: Column, title: Column, path: Column) -> Column:
    basis = F.coalesce(F.when(url != "", url), F.concat(F.coalesce(title, F.lit("")), F.lit(":"), F.coalesce(path, F.lit(""))))
    return F.coalesce(F.when(own != "", own), hash_id("legal_file", basis, 24))


def item_hash(*parts: Column | str) -> Column:
    """SHA-256 of the cleaned date, title, question and answer of a consultation."""
    return F.sha2(clean_advice(F.concat_ws("\n", *[or_empty(p) for p in parts])), 256)
