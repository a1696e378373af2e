"""Problem 5: cutting oversized texts at natural boundaries.

Offsets are prefix sums of unit sizes (1 per code point, or per token of a given token count). Boundaries are sorted
arrays, from paragraphs down to spaces. Each piece ends at the last boundary under the limit, found by binary search, of
the strongest kind that lies in the piece's later half; if there is none of any kind, it is cut hard, but not between a
letter and its marks. The next piece begins exactly ``overlap`` units before.

NULL and '' give no piece. A text within the limit is one piece. Rows that repeat give their pieces again.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = (
    re.compile(r"\r?\n[^\S\n]*\r?\n\s*"),
    re.compile(r"[\r\n]+"),
    re.compile(r"(?:[.؟!?;؛…](?=\s)|\.(?=$))[\s»\"')]*"),
    re.compile(r"[،,:](?=\s)\s*"),
    re.compile(r"\s+"),
)


def boundaries(text: str) -> list[list[int]]:
    """Of each kind, the sorted offsets at which a piece may end (after the white space)."""
    return [[m.end() for m in kind.finditer(text)] for kind in _KINDS]


def cuts(text: str, limit: int, overlap: int, sums: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) offsets of the pieces. sums[i] is the size of text[:i]; None counts code points."""
    if overlap < 0 or limit <= overlap:
        raise ValueError("the limit must be larger than the overlap")
    n = len(text)
    size = (lambda i: i) if sums is None else sums.__getitem__
    # the last offset whose prefix is within a size
    reach = (lambda s: min(n, s)) if sums is None else (lambda s: bisect_right(sums, s) - 1)
    if not n:
        return []
    kinds = boundaries(text) if size(n) > limit else []
    out, start = [], 0
    while True:
        top = reach(size(start) + limit)
        if top >= n:
            out.append((start, n))
            return out
        top = max(top, start + 1)  # one code point larger than the limit stands alone
        least = max(reach(size(start) + max(limit // 2, overlap)), start) + 1
        end = 0
        for ends in kinds:
            i = bisect_right(ends, top)
            if i and ends[i - 1] >= least:
                end = ends[i - 1]
                break
        if not end:
            end = top
            while end > least and (unicodedata.combining(text[end]) or text[end] in "‌‍" or text[end - 1] == "‍"):
                end -= 1
        out.append((start, end))
        back = end if sums is None else end
        start = max(start + 1, back - overlap if sums is None else reach(size(back) - overlap))


def _split(limit: int, overlap: int, schema: pa.Schema, token_sums: Callable[[str], list[int]] | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for k, text in zip(*(c.to_pylist() for c in part.columns)):
                at = cuts(text, limit, overlap, token_sums(text) if token_sums else None)
                rows += [(k, i, len(at), a, b, text[a:b]) for i, (a, b) in enumerate(at, 1)]
                if len(rows) > 2000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def split_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, token_sums: Callable[[str], list[int]] | None = None, only_larger: bool = False) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, piece): start and end are 0-based code point offsets, end exclusive.

    only_larger leaves out texts that need no cut; the JVM then drops what is surely short before Python sees it. token_sums
    gives the sizes of a text's beginnings, in tokens of the whole text; without it sizes are code points.
    """
    kind = dict(df.dtypes)[key]
    if kind not in ("bigint", "int", "string"):
        raise ValueError("the key must be an integer or a string")
    schema = pa.schema([("k", pa.string() if kind == "string" else pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string())])
    # a token has at least one byte, so a text of at most ``limit`` bytes needs no cut in tokens either
    size = F.octet_length(text) if token_sums else F.length(text)
    rows = df.where(size > (limit if only_larger else 0))
    k = F.col(key) if kind == "string" else F.col(key).cast("long")
    out = rows.select(k.alias("k"), F.col(text).alias("t")).mapInArrow(
        _split(limit, overlap, schema, token_sums), f"k {'string' if kind == 'string' else 'long'}, piece_no int, n_pieces int, start long, end long, piece string"
    )
    if only_larger and token_sums:
        out = out.where("n_pieces > 1")
    return out.withColumnRenamed("k", key)


def limit_of(size_limits: DataFrame, table: str, field: str) -> tuple[int, int, str]:
    """(max_size, overlap, unit) of a field: one row of a small settings table."""
    found = size_limits.where((F.col("table_name") == table) & (F.col("field_name") == field)).select("max_size", "overlap", "unit").orderBy("max_size").head(1)
    if not found:
        raise ValueError(f"no size limit for {table}.{field}")
    return int(found[0][0]), int(found[0][1] or 0), found[0][2]
