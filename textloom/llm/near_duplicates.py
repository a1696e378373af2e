"""Problem 2: near-duplicate records by a MinHash LSH forest and exact verification.

A tree of the forest is a trie over labels, sequences of MinHash values. Prefixes of length k need ``trees_for(k)`` trees
for the target recall at the threshold. Every record's prefix is adapted on its own: it stays short where at most
``MOST_COLLISIONS`` others share it over all of its trees; beyond that the record goes on with a prefix one longer, in as
many trees as that length needs. Two records meet at the length of the one that stays shorter, so no link is lost by it; at
the last length, set by ``MOST_HASHES`` values a record, prefixes are taken however crowded. Candidates must also agree in a
256-bit sketch (one bit per MinHash value, 4.5 deviations below what a pair at the threshold has: one such pair in 300,000 is
lost), which the join condition tests inside the JVM. What is left is verified exactly on the records' own shingles.

Exact copies (equal shingle sets) are one record until the end, so a group of copies that holds a third of all rows is
one label per tree; only the final pairs list its members. A record with fewer than k words has one shingle, all its words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import gram_hashes, mix, runs, word_hashes

#: Chance that a pair exactly at the threshold is a candidate; pairs above it are found more surely.
TARGET_RECALL = 0.985
#: Length of the first prefixes, and collisions of a record from which its prefix is made longer.
SHORTEST, MOST_COLLISIONS = 2, 8192
#: MinHash values of a record's longest labels; those of every record are for prefixes up to length STORED.
MOST_HASHES, STORED = 4096, 4
#: Bits of the sketch; pairs at J agree in (1 + J) / 2 of them.
BITS = 256


def trees_for(depth: int, threshold: float, recall: float = TARGET_RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def least_agreement(threshold: float, bits: int = BITS, deviations: float = 4.5) -> int:
    """Bits in which a pair at the threshold agrees, less some standard deviations."""
    p = (1 + threshold) / 2
    return math.floor(bits * p - deviations * math.sqrt(bits * p * (1 - p)))


def longest(threshold: float, recall: float = TARGET_RECALL) -> int:
    """The last length of a prefix: as long as its trees stay within MOST_HASHES values."""
    k = SHORTEST
    while (k + 1) * trees_for(k + 1, threshold, recall) <= MOST_HASHES:
        k += 1
    return k


@lru_cache(maxsize=8)
def _seeds(depth: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Two multipliers of the hash function at each place of each tree's label."""
    tree, place = (x.ravel() for x in np.mgrid[:trees, :depth])
    x = mix((tree.astype(np.uint64) << np.uint64(16)) + place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    y = mix(x)
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (y >> np.uint64(32)).astype(np.uint32)


def signature(grams: np.ndarray, depth: int, trees: int, part: int = 2048) -> np.ndarray:
    """trees x depth MinHash values of a non-empty set of 64-bit hashes; more trees or places leave the others as they are."""
    a, b = _seeds(depth, trees)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), part):
        np.minimum(out, (a[:, None] * x[None, i : i + part] + b[:, None]).min(axis=1), out=out)
    return out


def shingles(texts: list[str | None], k: int) -> np.ndarray:
    """The sorted set of hashes of k consecutive words of the texts joined by spaces, NULL as ''; of fewer words, one hash of all."""
    rs: list[str] = []
    for t in texts:
        rs += runs(t)
    return np.unique(gram_hashes(word_hashes(rs), min(k, len(rs)) or 1))


def _describe(k: int, depth: int, trees: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, *columns = [c.to_pylist() for c in part.columns]
            rows = []
            for i, texts in zip(ids, zip(*columns)):
                g = shingles(texts, k)
                if i is None or not len(g):
                    continue
                sig = signature(g, depth, trees)
                bits = np.packbits((mix(sig[:BITS].astype(np.uint64)) >> np.uint64(63)).astype(np.uint8)).view(np.int64)
                same = [np.bitwise_xor.reduce(mix(g)), mix(g * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(g))]
                rows.append((i, *np.array(same, np.uint64).view(np.int64).tolist(), *bits.tolist(), sig.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


_SKETCH = [f"s{i}" for i in range(BITS // 64)]


def described(df: DataFrame, id_column: str, fields: list[str], k: int, depth: int, trees: int) -> DataFrame:
    """id, two hashes of the whole shingle set, sketch, MinHash values (trees x depth) of every record that has a shingle."""
    names = ["id", "h0", "h1", *_SKETCH]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("sig", pa.binary())])
    slim = df.select(F.col(id_column).cast("long").alias("id"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    return slim.mapInArrow(_describe(k, depth, trees, schema), ", ".join(f"{n} long" for n in names) + ", sig binary")


def _labels(depth: int, trees: int, stored: int):
    """Keys of the prefixes of a length in each of the first trees, from signatures of labels of length ``stored``."""
    fields = ["key", "id", *_SKETCH]
    schema = pa.schema([(n, pa.int64()) for n in fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 60_000 // trees)
        for part in parts:
            for at in range(0, part.num_rows, step):
                p = part.slice(at, step)
                sig = np.frombuffer(b"".join(p.column("sig").to_pylist()), np.uint32).reshape(p.num_rows, -1, stored)
                sig = sig[:, :trees, :depth].astype(np.uint64)
                key = np.broadcast_to(mix(np.arange(trees, dtype=np.uint64) + np.uint64(1)), (p.num_rows, trees)).copy()
                for i in range(depth):
                    key = mix(key ^ sig[:, :, i]) + np.uint64(i)
                own = [np.repeat(p.column(n).to_numpy(), trees) for n in fields[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *map(pa.array, own)], schema=schema)

    return run, ", ".join(f"{n} long" for n in fields)


def forest_candidates(records: DataFrame, again: Callable[[DataFrame, int, int], DataFrame], threshold: float, recall: float) -> DataFrame:
    """(a, b), a < b, of records that share a prefix, by the walk described above.

    records: id, sketch and sig (labels of length STORED); again(ids, depth, trees) describes some records with longer ones.
    """
    near = (F.col("a.key") == F.col("b.key")) & _agree(least_agreement(threshold))
    meet = lambda x, y, also: x.alias("a").join(y.alias("b"), near & also).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    found, here, last = [], records, longest(threshold, recall)
    for depth in range(SHORTEST, last + 1):
        trees, stored = trees_for(depth, threshold, recall), min(STORED, last)
        if depth > stored:
            here, stored = written(again(here.select("id"), depth, trees), "longer-labels"), depth
        labels = lambda df: df.mapInArrow(*_labels(depth, trees, stored))  # noqa: E731, B023
        deeper = None
        if depth < last:
            # what crowds a record are prefixes with more than its share of the collisions
            crowded = labels(here).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_COLLISIONS / trees)
            crowded = written(crowded, "crowded")
            if crowded.head(1):
                deeper = labels(here).join(crowded, "key").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_COLLISIONS).select("id")
                deeper = written(deeper, "deeper")
        if deeper is None or not deeper.head(1):
            found.append(meet(labels(here), labels(here), F.col("a.id") < F.col("b.id")))
            break
        stay, here = here.join(deeper, "id", "left_anti"), written(here.join(deeper, "id", "left_semi"), "going-on")
        found += [meet(labels(stay), labels(stay), F.col("a.id") < F.col("b.id")), meet(labels(stay), labels(here), F.lit(True))]
    return reduce(DataFrame.unionByName, found).distinct()


def _agree(least: int) -> Column:
    return F.expr(" + ".join(f"bit_count(a.{s} ^ b.{s})" for s in _SKETCH) + f" <= {BITS - least}")


def _verify(k: int, threshold: float, fields: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = [c.to_pylist() for c in part.columns]
            found, sets = [], {}
            for a, b, *texts in zip(*columns):
                g = []
                for i, t in ((a, texts[:fields]), (b, texts[fields:])):
                    if i not in sets:
                        if len(sets) > 2000:
                            sets.clear()
                        sets[i] = shingles(t, k)
                    g.append(sets[i])
                both = len(np.intersect1d(*g, assume_unique=True))
                if both >= threshold * (len(g[0]) + len(g[1]) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def similar_pairs(df: DataFrame, id_column: str, fields: list[str], k: int = 5, threshold: float = 0.8, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of class representatives with Jaccard >= threshold, and membership (rep, id) of every record.

    A class is a set of records with one set of k-word shingles; its representative is the smallest id. Records without
    a word (NULL, '') or without an id have no class and no pair; those of fewer than k words link with equal ones. Ids must be unique; rows repeated under other
    ids are members of one class. Columns beyond id and fields are not read.
    """
    return _similar(df, id_column, fields, k, threshold, recall)[:2]


def _similar(df: DataFrame, id_column: str, fields: list[str], k: int, threshold: float, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``similar_pairs``, and the described records."""
    stored = min(STORED, longest(threshold, recall))
    trees = max(-(-BITS // stored), max(trees_for(d, threshold, recall) for d in range(SHORTEST, stored + 1)))
    all_records = written(described(df, id_column, fields, k, stored, trees), "described")
    members = all_records.groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    member_ids = all_records.select("id", "h0", "h1").join(members.select("h0", "h1", "rep"), ["h0", "h1"])
    copies = written(member_ids.select("rep", "id"), "copies")
    records = all_records.join(copies.where("id != rep").select("id"), "id", "left_anti")
    texts = df.select(F.col(id_column).cast("long").alias("id"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    again = lambda ids, depth, n: described(texts.join(ids, "id", "left_semi"), "id", texts.columns[1:], k, depth, max(n, -(-BITS // depth)))
    candidates = forest_candidates(records, again, threshold, recall)
    side = lambda x: df.select(F.col(id_column).cast("long").alias(x), *[F.col(f).alias(f"{x}{i}") for i, f in enumerate(fields)])
    full = candidates.join(side("a"), "a").join(side("b"), "b")
    full = full.select("a", "b", *[f"{x}{i}" for x in "ab" for i in range(len(fields))])
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pairs = full.mapInArrow(_verify(k, threshold, len(fields), out), "a long, b long")
    return pairs, copies, all_records


def all_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), row_id_a < row_id_b, of every two records: members of linked classes and of one class.

    The list is as long as its definition makes it; joins by class are left to adaptive skew handling.
    """
    one = copies.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    two = copies.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    between = pairs.join(one, "a", "left").join(two, "b", "left")
    between = between.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    within = one.join(two.withColumnRenamed("b", "a"), "a").where("ia < ib").select(F.col("ia").alias("x"), F.col("ib").alias("y"))
    return between.unionByName(within).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def _text_hash(schema: pa.Schema):
    """id, two hashes of the texts of records without a word."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, *columns = [c.to_pylist() for c in part.columns]
            rows = []
            for i, texts in zip(ids, zip(*columns)):
                whole = "\0".join(t or "" for t in texts)
                rows.append((i, *np.array([xxhash.xxh3_64_intdigest(whole, x) for x in (0, 1)], np.uint64).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], schema=schema)

    return run


def components(pairs: DataFrame) -> DataFrame:
    """(id, group) of every id in ``pairs`` (a, b): the smallest id that it is linked with, over however many others.

    Large stars, then small stars, until the edges stay the same; each round is written, so a lost executor repeats one
    round at most.
    """
    edges = written(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    groups = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return groups.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def duplicate_groups(df: DataFrame, id_column: str, fields: list[str], k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_links, group_id): every record with text, its class, how many other classes that class links to,
    and the group: the smallest id among all records that links of classes connect it with.

    Records without a word have no links; those of equal texts are one class.
    """
    pairs, copies, described_records = _similar(df, id_column, fields, k, threshold)
    pairs = written(pairs, "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = components(pairs).select(F.col("id").alias("class_id"), F.col("group").alias("group_id"))
    texts = df.where(F.length(F.concat_ws("", *fields)) > 0).select(F.col(id_column).cast("long").alias("id"), *fields)
    short = texts.join(described_records.select("id"), "id", "left_anti").where("id IS NOT NULL")
    short = written(short.mapInArrow(_text_hash(pa.schema([(n, pa.int64()) for n in ("id", "h0", "h1")])), "id long, h0 long, h1 long"), "short")
    same = short.groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = copies.unionByName(short.join(same, ["h0", "h1"]).select("rep", "id"))
    classed = texts.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    out = classed.join(links, "class_id", "left").join(groups, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
