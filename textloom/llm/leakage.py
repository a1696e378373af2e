"""Problem 8: evaluation passages inside a corpus, by winnowing.

Both sides keep the smallest k-gram hash of every window of ``least - k + 1`` k-grams, so two texts that share ``least``
consecutive words share a fingerprint. The corpus' fingerprints are joined with those of the items; a fixed bitmap of
the items' fingerprints keeps the others from leaving the scan. Hits are extended to the longest common run of words.

Items of fewer words are looked for whole: their only fingerprint is the hash of all their words, and documents keep
those of their k-grams of such lengths that the bitmap passes. NULL and '' hold nothing; repeated rows have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bitmaps import bitmap_of, members
from .words import gram_hashes, runs, word_hashes

K = 7


def fingerprints(h: np.ndarray, least: int, k: int = K) -> np.ndarray:
    """The minimum of each window of k-gram hashes, once each."""
    g = gram_hashes(h, k)
    width = least - k + 1
    if len(g) < width:
        return np.empty(0, np.uint64)
    return np.unique(sliding_window_view(g, width).min(axis=1))


def longest_run(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common run of at least ``least`` words, or zeros."""
    ga, gb = gram_hashes(a, least), gram_hashes(b, least)
    common = np.intersect1d(ga, gb)
    if not len(common):
        return 0, 0, 0
    at: dict[int, list[int]] = {}
    for i in np.nonzero(np.isin(gb, common))[0].tolist():
        at.setdefault(int(gb[i]), []).append(i)
    best = (0, 0, 0)
    ends: dict[int, int] = {}  # runs of matching grams by diagonal: where they may go on
    run: dict[int, int] = {}
    for i in np.nonzero(np.isin(ga, common))[0].tolist():
        for j in at[int(ga[i])]:
            d = i - j
            run[d] = run[d] + 1 if ends.get(d) == i - 1 else 1
            ends[d] = i
            n = run[d] + least - 1
            if n > best[0]:
                best = (n, i + least - n, j + least - n)
    return best


def _scan(least: int, k: int, bitmap: np.ndarray | None, lengths: list[int], schema: pa.Schema):
    """Fingerprints and word hashes; bitmap and lengths (of short items) are None and empty for the items themselves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, prints, whole = [], [], []
            for i, text in zip(*(c.to_pylist() for c in part.columns)):
                h = word_hashes(runs(text))
                f = fingerprints(h, least, k)
                if bitmap is None and 0 < len(h) < least:
                    f = gram_hashes(h, len(h))
                if bitmap is not None:
                    f = np.unique(np.concatenate([f, *[gram_hashes(h, n) for n in lengths]])) if lengths else f
                    f = f[members(bitmap, f)] if len(f) else f
                if len(f):
                    ids.append(i)
                    prints.append(f.view(np.int64).tolist())
                    whole.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(whole, pa.binary())], schema=schema)

    return run


_SCHEMA = pa.schema([("id", pa.int64()), ("prints", pa.list_(pa.int64())), ("words", pa.binary())])
_DDL = "id long, prints array<long>, words binary"


def _extend(least: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for d, i, a, b in zip(*(c.to_pylist() for c in part.columns)):
                n, at, item_at = longest_run(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), min(least, len(b) // 8))
                if n:
                    rows.append((d, i, n, at, item_at))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): the longest common run of each document and item, 0-based starts:
    at least ``least`` words, or the whole item if it is shorter.

    Ids are integers and unique on each side; rows without an id are left out. Words are attached to pairs of ids only.
    """
    slim = lambda df, i: df.where((F.length(text) > 0) & F.col(i).isNotNull()).select(F.col(i).cast("long").alias("id"), F.col(text).alias("t"))
    marked = written(slim(items, item_id).mapInArrow(_scan(least, K, None, [], _SCHEMA), _DDL), "items")
    bitmap = bitmap_of(marked.select(F.explode("prints").alias("p")))
    words = (F.length("words") / 8).cast("int")
    lengths = sorted(r[0] for r in marked.select(words).where(words < least).distinct().collect())  # fewer than ``least``
    hit = written(slim(documents, doc_id).mapInArrow(_scan(least, K, bitmap, lengths, _SCHEMA), _DDL), "hits")
    left = hit.select(F.col("id").alias("d"), F.explode("prints").alias("p"))
    right = marked.select(F.col("id").alias("i"), F.explode("prints").alias("p"))
    both = left.join(right, "p").select("d", "i").distinct().join(hit.select(F.col("id").alias("d"), F.col("words").alias("a")), "d")
    whole = marked.select(F.col("id").alias("i"), F.col("words").alias("b"))
    schema = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("n_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])
    out = both.join(whole, "i").select("d", "i", "a", "b").mapInArrow(_extend(least, schema), "d long, i long, n_words int, doc_word int, item_word int")
    return out.withColumnsRenamed({"d": doc_id, "i": item_id})
