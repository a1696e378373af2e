"""Chunks of graph nodes and of documents, their ids, shards and retry waves."""

from __future__ import annotations

import base64
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, uuid5
from ..functions.text import SPACE

# Labels that say nothing about a node's kind, and the URL namespace of UUIDs.
PLAIN_LABELS = ("LegalEntity", "LawNode", "Laws", "Unanimity")
URL_NAMESPACE = uuid.NAMESPACE_URL


_ENDS = re.compile(r"\n|\.(?= )")


def windows(text: str, longest: int, overlap: int) -> list[str]:
    """Pieces of the stripped, non-blank lines of a text: at most ``longest`` characters from each start, ending with the
    last line or sentence that is seen whole in them if that lies in the later half, and overlapping by ``overlap``.

    Ends are sorted offsets, found once; each piece looks its own up by binary search.
    """
    s = "\n".join(filter(None, map(str.strip, text.splitlines())))
    ends = [m.end() for m in _ENDS.finditer(s)]
    seen = [e + (s[e - 1] == ".") for e in ends]  # a full stop ends a sentence where the space after it is seen too
    spans, start = [], 0
    while start < len(s):
        last = min(start + longest, len(s))
        at = bisect_right(seen, last) - 1
        if last < len(s) and at >= 0 and ends[at] - start > longest // 2 + 1:
            last = ends[at]
        spans.append((start, last))
        start = len(s) if last == len(s) else last - overlap
    return [piece for a, b in spans if (piece := s[a:b].strip())]


def character_chunks(df: DataFrame, key: str, text: str, longest: int = 4000, overlap: int = 300, title: str | None = None) -> DataFrame:
    """(key, chunk_index, chunk_count, text); a text without characters gives its title as its only chunk, if asked."""
    if longest <= 0 or not 0 <= overlap < longest:
        raise ValueError("the overlap must lie between zero and the length")

    @F.arrow_udf("array<string>")
    def cut(values: pa.Array) -> pa.Array:
        return pa.array([windows(t or "", longest, overlap) for t in values.to_pylist()], pa.list_(pa.string()))

    pieces = df.select(key, cut(F.col(text)).alias("p"), (F.col(title) if title else F.lit(None).cast("string")).alias("_title"))
    if title:
        pieces = pieces.withColumn("p", F.when((F.size("p") == 0) & F.col("_title").isNotNull(), F.array("_title")).otherwise(F.col("p")))
    return pieces.select(key, F.size("p").alias("chunk_count"), F.posexplode("p").alias("i", "text")).select(key, (F.col("i") + 1).alias("chunk_index"), "chunk_count", "text")


def document_chunks(df: DataFrame, longest: int = 4000, overlap: int = 300) -> DataFrame:
    """Chunks of documents (document_id, title, text) with chunk id, point id and embedding input."""
    chunks = character_chunks(df, "document_id", "text", longest, overlap, "title").join(df.select("document_id", "title"), "document_id")
    own = chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text"))
    chunks = chunks.withColumn("id", own).withColumn("point_id", uuid5(URL_NAMESPACE, own))
    return chunks.withColumn("embedding_input", F.concat(F.col("title"), F.lit("\n\n"), F.col("text")))


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), SPACE + "+"), lambda w: w != "")


def heading(title: Column, labels: Column) -> Column:
    """The lines on title and kind before a chunk; '' if there are none."""
    kinds = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: ~x.isin(*PLAIN_LABELS))
    return F.concat_ws("\n", F.when(title != "", F.concat(F.lit("عنوان: "), title)), F.when(F.size(kinds) > 0, F.concat(F.lit("نوع: "), F.array_join(kinds, ", "))))


def token_chunks(df: DataFrame, key: str, text: str, title: Column, labels: Column, most: int, overlap: int, namespace: uuid.UUID = URL_NAMESPACE, collection: str = "nodes") -> DataFrame:
    """Chunks of at most ``most`` words, the heading included, each repeating ``overlap`` words of the one before.

    A closed form, without a loop: n words in windows of a with overlap o make 1 + ceil((n - a) / (a - o)) chunks. Raises
    if a heading leaves no room. A text without words has no chunk.
    """
    rows = df.select(key, words(F.col(text)).alias("w"), heading(title, labels).alias("h"))
    rows = rows.withColumn("h_n", F.size(words(F.col("h")))).withColumn("a", most - F.col("h_n"))
    room = F.when(F.col("a") > overlap, F.col("a")).otherwise(F.raise_error(F.lit("a heading leaves no room for words")).cast("int"))
    rows = rows.where(F.size("w") > 0).withColumn("a", room)
    n = F.when(F.size("w") <= F.col("a"), 1).otherwise(1 + F.ceil((F.size("w") - F.col("a")) / (F.col("a") - overlap)).cast("int"))
    rows = rows.withColumn("chunk_count", n).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.slice("w", F.col("i") * (F.col("a") - overlap) + 1, F.col("a"))
    rows = rows.withColumn("piece", piece).withColumn("chunk_index", F.col("i") + 1)
    name = F.concat_ws("\0", F.lit(collection), F.col(key), F.col("chunk_index").cast("string"))
    body = F.array_join("piece", " ")
    return rows.select(
        key, uuid5(namespace, name).alias("point_id"), "chunk_index", "chunk_count",
        F.when(F.col("h") != "", F.concat("h", F.lit("\n\n"), body)).otherwise(body).alias("text"), (F.col("h_n") + F.size("piece")).alias("token_count"),
    )


def subword_chunks(df: DataFrame, key: str, text: str, title: Column, labels: Column, most: int, overlap: int, ranks: str, pattern: str) -> DataFrame:
    """``token_chunks`` in tokens of a byte-level vocabulary: (key, chunk_index, chunk_count, text, token_count).

    ranks: a file of base64 tokens with their ranks, read on every machine; pattern: how texts are divided before merging.
    The heading is part of every chunk and of its size. Raises if a heading leaves no room.
    """
    schema = pa.schema([("k", pa.string()), ("chunk_index", pa.int32()), ("chunk_count", pa.int32()), ("text", pa.string()), ("token_count", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for part in parts:
            rows: list[tuple] = []
            for k, body, head in zip(*(c.to_pylist() for c in part.columns)):
                top = coder.encode_ordinary(head + "\n\n") if head else []
                own, room = coder.encode_ordinary(body), most - len(top)
                if own and room <= overlap:
                    raise ValueError("a heading leaves no room for tokens")
                count = (1 if len(own) <= room else 1 + -(-(len(own) - room) // (room - overlap))) if own else 0
                for i in range(count):
                    piece = own[i * (room - overlap) : i * (room - overlap) + room]
                    rows.append((k, i + 1, count, coder.decode(top + piece), len(top) + len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    slim = df.where(F.length(text) > 0).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.coalesce(heading(title, labels), F.lit("")).alias("h"))
    return slim.mapInArrow(run, "k string, chunk_index int, chunk_count int, text string, token_count int").withColumnRenamed("k", key)


@lru_cache(maxsize=2)
def _coder(ranks: str, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(ranks).name, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """1-based numbers over a total order, without one task for all rows: ranges are sorted, counted and offset."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = spread.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    from ..session import written

    parts = written(parts, "numbered")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", "_first", before.alias("_before"))
    return parts.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1).drop("_part", "_seq", "_first", "_before")


def shards(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """shard, place in it, and custom_id of each row in a total order."""
    rows = numbered(df, order)
    shard = F.floor((F.col("rn") - 1) / size).cast("int") + 1
    place = ((F.col("rn") - 1) % size).cast("int") + 1
    rows = rows.withColumn("shard", shard).withColumn("place", place).drop("rn")
    return rows.withColumn("custom_id", F.format_string("graph-%04d-%06d", "shard", "place"))


def wave(shard_tokens: DataFrame, budget: int) -> DataFrame:
    """(shard, tokens, taken): shards in order that fit a budget; one too large is passed over, and later ones are tried.

    A state table of one row per shard; the fold runs over it in order within one task, row by row.
    """
    schema = pa.schema([("shard", pa.int64()), ("tokens", pa.int64()), ("taken", pa.bool_())])

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0
        for part in parts:
            taken = []
            for t in part.column(1).to_pylist():
                fits = used + t <= budget
                used += t if fits else 0
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(taken)], schema=schema)

    rows = shard_tokens.select(F.col("shard").cast("long"), F.col("tokens").cast("long"))
    return rows.coalesce(1).sortWithinPartitions("shard").mapInArrow(fold, "shard long, tokens long, taken boolean")
