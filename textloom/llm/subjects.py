"""Problem 9: subject areas of documents, by bisecting k-means and leaf mixtures.

1. Document frequencies of hashed words and word pairs are counted over all documents.
2. Normalised tf-idf vectors, hashed to ``DIMS`` numbers, are clustered by bisecting spherical k-means over all documents;
   the leaf with the largest scatter is split next. Each pass takes all nodes that may be among the leaves a step on; a
   node of at most ``HELD`` documents is bisected whole by one task. Passes of k-means over all documents move the leaves'
   centres, and every document goes to a leaf.
3. Leaves get a subject mixture from the labels in them, counted over all documents. Terms are discriminative by their
   log-odds in the subjects of their leaves; by them each sentence of the corpus goes to a subject, which gives terms and
   leaves their final odds and mixtures.
4. Every document goes to its leaf. The leaf's mixture and the terms of its sentences share out its words by expectation
   maximisation; its subjects are those with at least a fifth of them.

NULL and '' have no subject. Sentences without discriminative terms count as text on no subject. Repeated documents are
judged alike; texts are read whole. Without labels there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .confusables import consistent
from .words import mix, word

BUCKETS = 1 << 16
#: Length of a document's vector, and its norm in the bisection, where numbers are whole: sums of products of two vectors, and
#: of PART numbers, stay below 2 ** 24, so floats of 32 bits hold them exactly, in whatever order they are added.
DIMS, NORM, PART = 512, 4000, 4096
#: Rows of float numbers that are multiplied at once: 1 MB.
PIECE = 512
#: Documents that one task bisects whole: 64 MB, and 32 MB for the float numbers of a node of at most 4 PART.
HELD = 1 << 16
#: Vectors in a row of the stage that the passes read.
PACK = 8
#: Bytes that the tasks of a pass may send to the driver; if they have more, tasks join what they found.
DIRECT = 1 << 24
LEAVES, LEAST_LEAF, STEPS, MIXTURE_STEPS = 144, 4, 10, 6
#: Passes of k-means over all documents.
PASSES = 2
#: Parts of the buckets, each added up by one task.
SLICES = 64
#: Labelled documents that a leaf's mixture counts like, of the corpus' own mixture.
LEAF_PRIOR = 0.5
#: Share of a document's words that makes an area of it.
LEAST_SHARE = 0.2
#: What every subject has in a document beside the mixture of its leaf, and how many subjects of a leaf share its terms.
FLOOR, TOP = 0.05, 4
#: Log-odds from which a sentence belongs to a subject.
LEAST_ODDS = 2.0
#: Letters and digits (1), ends of sentences (2) and other characters (0) below U+10000.
_KIND = np.fromiter(map(str.isalnum, map(chr, range(1 << 16))), np.uint8, 1 << 16)
_KIND[[ord(c) for c in ".؟!?؛;\r\n"]] = 2
#: Characters that are divided into tokens at once, unless one text has more.
TOGETHER = 1 << 19
#: Hashes of words kept per worker, each in the place that the first bits of its word's polynomial over 2 ** 64 give; two words
#: that share all 64 bits would be taken for one.
_KEPT_BITS, _POWER = 18, 0x9E3779B97F4A7C15
_kept_keys, _kept_hashes = np.zeros(1 << _KEPT_BITS, np.uint64), np.zeros(1 << _KEPT_BITS, np.uint64)
_HALF = np.uint64(BUCKETS // 2)


def _word_hash(token: str) -> int:
    return (xxhash.xxh3_64_intdigest(word(token)) & ~1 | (token < "\u0250")) or 2


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, 0 for each end of a sentence; tokens up to the end of each text, an end of a sentence the last)."""
    text = "\n".join([*texts, ""])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _KIND[np.minimum(code, (1 << 16) - 1)]
    wide = np.nonzero(code >> 16)[0]
    kind[wide] = [chr(c).isalnum() for c in code[wide].tolist()]
    letter = kind == 1
    first = kind == 2
    first[0] |= letter[0]
    first[1:] |= letter[1:] & ~letter[:-1]
    start = np.nonzero(first)[0]
    h = np.zeros(len(start), np.uint64)
    is_word = letter[start]
    start_of_word, end_of_word = start[is_word], np.nonzero(letter[:-1] & ~letter[1:])[0] + 1
    if len(start_of_word):
        sizes = end_of_word - start_of_word
        begin = np.cumsum(sizes) - sizes
        powers = np.cumprod(np.full(sizes.max(), _POWER, np.uint64))
        value = powers[np.arange(sizes.sum()) - np.repeat(begin, sizes)]
        value *= code[letter]
        key = np.add.reduceat(value, begin)
        place = (key >> np.uint64(64 - _KEPT_BITS)).astype(np.int64)
        own = np.where(_kept_keys[place] == key, _kept_hashes[place], np.uint64(0))
        if len(new := np.nonzero(own == 0)[0]):
            keys, at, of = np.unique(key[new], return_index=True, return_inverse=True)
            hashes = np.array([_word_hash(text[a:b]) for a, b in zip(start_of_word[new[at]].tolist(), end_of_word[new[at]].tolist())], np.uint64)
            own[new] = hashes[of]
            _kept_keys[place[new[at]]], _kept_hashes[place[new[at]]] = keys, hashes
        h[is_word] = own
    return h, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def _bucket(x: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Even buckets for other scripts, odd ones for Latin letters and digits."""
    return (x >> np.uint64(1)) % (_HALF >> np.uint64(1)) * np.uint64(2) + script


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of words and word pairs, number of buckets of each sentence, number of sentences of each text)."""
    parts, at = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
    forms = [consistent(t) or "" for t in texts]
    while at < len(forms):
        length, to = len(forms[at]), at + 1
        while to < len(forms) and (length := length + len(forms[to])) <= TOGETHER:
            to += 1
        parts.append(_tokens(forms[at:to]))
        at = to
    h = np.concatenate([own for own, _ in parts])
    before = np.cumsum([0] + [len(own) for own, _ in parts])
    ends = np.concatenate([own + n for (_, own), n in zip(parts, before)])
    is_word = h != 0
    pair = is_word & np.append(is_word[1:], False)
    script = h & np.uint64(1)
    after = mix(mix(h) + np.append(h[1:], np.uint64(0)))
    both = np.stack([_bucket(h, script), _bucket(after, script) + _HALF], axis=1).ravel()
    keep = np.stack([is_word, pair], axis=1).ravel()
    sentence = np.repeat(np.cumsum(~is_word), 2)[keep]
    first = np.append(True, sentence[1:] != sentence[:-1]) if len(sentence) else np.empty(0, bool)
    sizes = np.diff(np.append(np.nonzero(first)[0], len(sentence)))
    at_token = np.repeat(np.arange(len(h)), 2)[keep][first] if len(sentence) else np.empty(0, np.int64)
    per_text = np.diff(np.append(0, np.searchsorted(at_token, ends)))
    return both[keep].astype(np.int64), sizes, per_text


_spots = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64))
_SLOT, _SIGN = (_spots % np.uint64(DIMS)).astype(np.int64), np.where(_spots >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def vectors(f: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Documents x DIMS: tf-idf rows of norm 1 by a signed hash of the buckets, which keeps their cosines within chance."""
    n = len(per_doc)
    row = np.repeat(np.arange(n), np.add.reduceat(sizes, np.cumsum(per_doc) - per_doc)) if n else np.empty(0, np.int64)
    cell, times = np.unique((row * BUCKETS + f).astype(np.uint32 if n < 1 << 15 else np.int64), return_counts=True)
    bucket = (cell % BUCKETS).astype(np.int64)
    value = (1 + np.log(times)) * idf[bucket] * _SIGN[bucket]
    out = np.bincount((cell // BUCKETS).astype(np.int64) * DIMS + _SLOT[bucket], value, n * DIMS).reshape(n, DIMS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _plane(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole numbers; a row's product with them is at least 0 if it is as near to a as to b."""
    return np.rint((_unit(a.astype(float)) - _unit(b.astype(float))) * (NORM / 2)).astype(np.float32)


class Node:
    """Documents of the bisection: their number, the sum of their vectors, and how far their spherical 2-means has come.

    It begins from the row farthest from the mean and the one farthest from that; then come up to STEPS steps.
    """

    def __init__(self, n: int, total: np.ndarray, most: float = np.inf):
        self.n, self.total = n, total
        self.scatter = min(most, max(0.0, n - float(np.linalg.norm(total)) / NORM)) if n >= 2 * LEAST_LEAF else 0.0
        self.v = np.rint(_unit(total.astype(float)) * NORM).astype(np.float32)
        self.step, self.side, self.below = -2, (0, total), ()

    @property
    def rank(self) -> tuple[float, bytes]:
        """The least is split next."""
        return -self.scatter, self.total.tobytes()

    @property
    def seeks(self) -> bool:
        return self.step < 0

    def met(self, n: int, x: np.ndarray) -> bool:
        """Takes what the rows gave for the direction ``v``; whether that was the last step."""
        if self.seeks:
            self.v = _plane(self.side[1], x) if self.step == -1 else x.astype(np.float32)
            self.side, self.step = (0, x), self.step + 1
            return False
        same = n == self.side[0] and bool((x == self.side[1]).all())
        self.side, self.step = (n, x), self.step + 1
        if same or self.step == STEPS or not 0 < n < self.n:
            return True
        self.v = _plane(x, self.total - x)
        return False

    def parts(self) -> tuple[Node, Node] | None:
        n, x = self.side
        return (Node(n, x, self.scatter), Node(self.n - n, self.total - x, self.scatter)) if 0 < n < self.n else None


def _look(own: np.ndarray, v: np.ndarray, seeks: bool) -> tuple[int, bytes | np.ndarray]:
    """Of at most PART rows, (product, row) with the least product with v; or number and sum of the rows where it is 0 or more."""
    value = own @ v
    if seeks:
        return int(value.min()), min(x.astype(np.int16).tobytes() for x in own[value == value.min()])
    side = value >= 0
    return int(side.sum()), (side.astype(np.float32) @ own).astype(np.int64)


def _joined(a: tuple | None, b: tuple, seeks: bool) -> tuple[int, bytes | np.ndarray]:
    return b if a is None else min(a, b) if seeks else (a[0] + b[0], a[1] + b[1])


def _found(x: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(x, np.int16).astype(np.int64) if isinstance(x, bytes) else x


def bisected(x: np.ndarray, root: Node, most: int) -> list[tuple[int, int, np.ndarray]]:
    """Up to ``most`` splits of the rows of x, all of them those of root, by falling scatter: (node, number and sum of its first part).

    Nodes are numbered as they come, the two parts of the i-th split 2 i + 1 and 2 i + 2.
    """
    nodes, rows, open_, out = [root], [np.arange(len(x))], {0}, []
    while len(out) < most and open_:
        i = min(open_, key=lambda j: nodes[j].rank)
        node, own = nodes[i], rows[i]
        open_.remove(i)
        if not node.scatter:
            break
        read = lambda own=own: (x[own[at : at + PIECE]].astype(np.float32) for at in range(0, len(own), PIECE))
        if len(own) <= 4 * PART:
            kept = list(read())
            read = lambda kept=kept: kept
        done = False
        while not done:
            seen = None
            for y in read():
                seen = _joined(seen, _look(y, node.v, node.seeks), node.seeks)
            done = node.met(seen[0], _found(seen[1]))
        if parts := node.parts():
            side = np.concatenate([y @ node.v >= 0 for y in read()])
            open_ |= {len(nodes), len(nodes) + 1}
            nodes += parts
            rows += [own[side], own[~side]]
            rows[i] = own[:0]
            out.append((i, *node.side))
    return out


def _log_odds(counts: np.ndarray, whole: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """How much oftener a term is in a column than expected among terms of its script, as a logarithm: buckets x columns."""
    out = np.empty(counts.shape, np.float32)
    for i in (0, 1):
        all_ = whole[i::2]
        for j in range(counts.shape[1]):  # by column, to keep the memory small
            own = counts[i::2, j]
            out[i::2, j] = np.log((own + prior) / (all_ * (own.sum() / max(all_.sum(), 1e-9)) + prior))
    return out


def mixtures(scores: np.ndarray, words: np.ndarray, docs: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities of each sentence, mixture of each document) by expectation maximisation.

    scores: sentences x subjects, the last column text on no subject; docs: first sentence of each document; allowed:
    documents x subjects, a factor of the mixture.
    """
    of = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(scores))))
    like = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))
    total = np.add.reduceat(words, docs)[:, None]
    theta = np.full((len(docs), scores.shape[1]), 1 / scores.shape[1])
    for _ in range(MIXTURE_STEPS):
        if allowed is not None:
            theta = theta * allowed
        resp = like * theta[of]
        resp /= resp.sum(axis=1, keepdims=True)
        theta = (np.add.reduceat(resp * words[:, None], docs, axis=0) + 0.01) / (total + 0.01 * scores.shape[1])
    return resp, theta


def _by_sentence(weights: np.ndarray, f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of weights over each sentence, in parts that bound the memory."""
    out, step = [], 100
    for i in range(0, len(starts), step):
        own = starts[i : i + step]
        end = starts[i + step] if i + step < len(starts) else len(f)
        out.append(np.add.reduceat(weights.take(f[own[0] : end], axis=0), own - own[0], axis=0))
    return np.concatenate(out)


class Model:
    """subjects; weights of buckets for each subject and, last, for text on none; leaves, and their mixtures of subjects."""

    def __init__(self, subjects: list[str], weights: np.ndarray, idf: np.ndarray, centres: np.ndarray, mixture: np.ndarray):
        self.subjects, self.weights = subjects, weights.astype(np.float32)
        self.idf, self.centres, self.mixture = idf.astype(np.float32), centres, mixture

    def leaf(self, f: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        return (vectors(f, sizes, per_doc, self.idf) @ self.centres.T).argmax(axis=1)

    def scores(self, f: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own = _by_sentence(self.weights, f, np.cumsum(sizes) - sizes)
        own[:, -1] = np.maximum(own[:, -1], LEAST_ODDS)
        return own.astype(float)

    def shares(self, f: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Documents x subjects: the share of each subject in a document's words, by sentences and the mixture of its leaf."""
        words, docs = (sizes + 1) / 2, np.cumsum(per_doc) - per_doc
        resp, _ = mixtures(self.scores(f, sizes), words, docs, self.mixture[self.leaf(f, sizes, per_doc)] + FLOOR)
        hard = np.zeros_like(resp)
        hard[np.arange(len(resp)), resp.argmax(axis=1)] = words
        return (np.add.reduceat(hard, docs, axis=0) / np.add.reduceat(words, docs)[:, None])[:, :-1]


_SCHEMA = pa.schema([("k", pa.int64()), ("f", pa.binary()), ("sizes", pa.binary())])


def _describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, 500):
            p = part.slice(at, 500)
            f, sizes, per_text = features(p.column(1).to_pylist())
            f, sizes, size_end = f.astype(np.uint16), sizes.astype(np.uint32), np.cumsum(per_text)
            f_end = np.append(0, np.cumsum(sizes, dtype=np.int64))[size_end]
            cut = lambda x, ends: [x[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]
            batch = pa.RecordBatch.from_arrays([p.column(0), pa.array(cut(f, f_end), pa.binary()), pa.array(cut(sizes, size_end), pa.binary())], schema=_SCHEMA)
            yield batch.filter(pa.array(per_text > 0))


def described(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k, f, sizes of every document with a word: buckets and sentence sizes. Documents without an id are left out."""
    slim = documents.where((F.length(text) > 0) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(_describe, "k long, f binary, sizes binary")


def _arrays(f: list[bytes], sizes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per_doc = np.array([len(z) // 4 for z in sizes], np.int64)
    return np.frombuffer(b"".join(f), np.uint16).astype(np.int64), np.frombuffer(b"".join(sizes), np.uint32).astype(np.int64), per_doc


def _frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for part in parts:
        for at in range(0, part.num_rows, 500):
            own = part.column(0).slice(at, 500).to_pylist()
            row = np.repeat(np.arange(len(own), dtype=np.uint32), [len(x) // 2 for x in own])
            cell = np.sort(row * np.uint32(BUCKETS) + np.frombuffer(b"".join(own), np.uint16))
            df += np.bincount(cell[np.append(True, cell[1:] != cell[:-1])] % np.uint32(BUCKETS), minlength=BUCKETS)
        n += part.num_rows
    at = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def document_frequencies(records: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents: at most BUCKETS + 1 numbers reach the driver."""
    counts = records.select("f").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    out, n = np.zeros(BUCKETS), 0
    for b, k in counts.collect():
        if b < 0:
            n = k
        else:
            out[b] = k
    return out, int(n)


def _part(p: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _arrays(p.column("f").to_pylist(), p.column("sizes").to_pylist())


def _added(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], shape: tuple[int, int], times: np.ndarray | None = None) -> np.ndarray:
    """What ``add`` adds to an array of this shape, over all rows; with ``times``, it counts in an array of as many rows, of whole
    numbers, whose product with ``times`` has this shape.

    Tasks send the cells that aren't 0, and each of SLICES slices is added up by one task: an array of fixed size reaches
    the driver, however many rows there are.
    """
    cells = -(-shape[0] * shape[1] // SLICES)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(SLICES * cells)
        sums = flat[: shape[0] * shape[1]].reshape(shape)
        own = sums if times is None else np.zeros((shape[0], len(times)), np.uint32)
        for part in parts:
            for at in range(0, part.num_rows, 500):
                add(own, part.slice(at, 500))
        for at in range(0, shape[0] if times is not None else 0, PART):
            sums[at : at + PART] = own[at : at + PART] @ times
        for i, own in enumerate(flat.reshape(SLICES, cells)):
            at = np.nonzero(own)[0].astype(np.uint32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([own[at].astype(np.float32).tobytes()], pa.binary())], names=["slice", "cells", "sums"])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for i, c, v in zip(*[x.to_pylist() for x in part.columns]):
                if i not in sums:
                    sums[i] = np.zeros(cells)
                sums[i][np.frombuffer(c, np.uint32)] += np.frombuffer(v, np.float32)
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["slice", "sums"])

    sent = rows.mapInArrow(send, "slice int, cells binary, sums binary").repartition("slice")
    out = np.zeros((SLICES, cells), np.float32)
    for i, own in sent.mapInArrow(total, "slice int, sums binary").toLocalIterator():
        out[i] = np.frombuffer(own, np.float32)
    return out.ravel()[: shape[0] * shape[1]].reshape(shape)


def packed(x: np.ndarray, each: int = PACK) -> pa.RecordBatch:
    """Whole numbers (n, x): the rows of x, ``each`` in a row, compressed."""
    x = x.astype(np.int16)
    parts = [x[at : at + each] for at in range(0, len(x), each)]
    columns = [pa.array([len(y) for y in parts], pa.int32()), pa.array([pa.compress(y.tobytes(), codec="lz4_raw", asbytes=True) for y in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["n", "x"])


def _rows(p: pa.RecordBatch | pa.Table) -> np.ndarray:
    size, codec = np.dtype(np.int16).itemsize * DIMS, pa.Codec("lz4_raw")
    parts = [codec.decompress(x.as_buffer(), n * size) for n, x in zip(p.column("n").to_pylist(), p.column("x"))]
    return np.frombuffer(b"".join(parts), np.int16).reshape(-1, DIMS)


class Tree:
    """Nodes of the bisection; a node that is split has its two parts in ``below``."""

    def __init__(self, root: Node):
        self.nodes = [root]

    def split(self, i: int, parts: tuple[Node, Node]) -> None:
        self.nodes[i].below = (len(self.nodes), len(self.nodes) + 1)
        self.nodes += parts

    def wanted(self) -> list[int]:
        """Nodes to be split yet that may be among the LEAVES - 1 splits: no part scatters more than the whole."""
        first = sorted((i for i, x in enumerate(self.nodes) if x.scatter > 0), key=lambda i: self.nodes[i].rank)
        return [i for i in first[: LEAVES - 1] if not self.nodes[i].below]

    def left(self, i: int) -> int:
        """Splits that nodes with more scatter leave to this node and its parts."""
        return LEAVES - 1 - sum(x.scatter > self.nodes[i].scatter for x in self.nodes if x.below)

    def leaves(self) -> list[Node]:
        out = [0]
        while len(out) < LEAVES and (split := [i for i in out if self.nodes[i].below]):
            i = min(split, key=lambda j: self.nodes[j].rank)
            at = out.index(i)
            out[at : at + 1] = self.nodes[i].below
        return [self.nodes[i] for i in out]

    def placer(self) -> Callable[[np.ndarray], np.ndarray]:
        """Gives the node that isn't split of each row."""
        inner = [i for i, x in enumerate(self.nodes) if x.below]
        planes = np.array([self.nodes[i].v for i in inner], np.float32).reshape(-1, DIMS).T
        plane, below = np.full(len(self.nodes), -1), np.zeros((len(self.nodes), 2), np.int64)
        plane[inner] = np.arange(len(inner))
        for i in inner:
            below[i] = self.nodes[i].below

        def place(x: np.ndarray) -> np.ndarray:
            at, every = np.zeros(len(x), np.int64), np.arange(len(x))
            if len(inner):
                second = (x @ planes < 0).astype(np.int64)
                while (deeper := plane[at] >= 0).any():
                    at = np.where(deeper, below[at, second[every, plane[at]]], at)
            return at

        return place


def _by_node(parts: Iterator[pa.RecordBatch], place: Callable[[np.ndarray], np.ndarray], wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows of it), at most PART, for the wanted nodes."""
    for part in parts:
        for start in range(0, part.num_rows, PART // PACK):
            x = _rows(part.slice(start, PART // PACK)).astype(np.float32)
            at = place(x)
            order = np.argsort(at, kind="stable")
            nodes, first = np.unique(at[order], return_index=True)
            for i, own in zip(nodes.tolist(), np.split(order, first[1:])):
                if i in wanted:
                    yield i, x[own]


def _looked(vectors: DataFrame, place: Callable[[np.ndarray], np.ndarray], directions: dict[int, tuple[np.ndarray, bool]], direct: bool) -> dict[int, tuple[int, np.ndarray]]:
    """What ``_look`` finds for the direction of each node, in one pass: if not direct, one row of fixed size a node reaches the driver."""
    schema = pa.schema([("node", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])

    def batch(found: dict[int, tuple]) -> pa.RecordBatch:
        xs = [x if isinstance(x, bytes) else x.tobytes() for _, x in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array(xs, pa.binary())], schema=schema)

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for i, own in _by_node(parts, place, set(directions)):
            found[i] = _joined(found.get(i), _look(own, *directions[i]), directions[i][1])
        yield batch(found)

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for part in parts:
            for i, n, x in zip(*[c.to_pylist() for c in part.columns]):
                seeks = directions[i][1]
                found[i] = _joined(found.get(i), (n, x if seeks else np.frombuffer(x, np.int64)), seeks)
        yield batch(found)

    form = "node int, n long, x binary"
    rows = vectors.mapInArrow(look, form)
    if not direct:
        rows = rows.repartition("node").mapInArrow(total, form)
    found: dict[int, tuple] = {}
    for i, n, x in rows.collect():
        seeks = directions[i][1]
        found[i] = _joined(found.get(i), (n, bytes(x) if seeks else np.frombuffer(x, np.int64)), seeks)
    return {i: (n, _found(x)) for i, (n, x) in found.items()}


def _split_whole(vectors: DataFrame, tree: Tree, wanted: list[int]) -> None:
    """Bisects nodes that a task can hold, each in one task: at most LEAVES splits of each reach the driver."""
    place, nodes = tree.placer(), set(wanted)
    own, most = {i: tree.nodes[i] for i in wanted}, {i: tree.left(i) for i in wanted}

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x in _by_node(parts, place, nodes):
            p = packed(x, PART)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *p.columns], names=["node", "n", "x"])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i = key[0].as_py()
        found = bisected(_rows(rows), own[i], most[i])
        columns = [[i] * len(found), list(range(len(found))), [j for j, _, _ in found], [n for _, n, _ in found], [t.tobytes() for _, _, t in found]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["node", "i", "of", "n", "x"])

    sent = vectors.mapInArrow(send, "node int, n int, x binary").groupBy("node").applyInArrow(run, "node int, i int, of int, n long, x binary")
    ids: dict[int, list[int]] = {i: [i] for i in wanted}
    for i, _, of, n, x in sorted(sent.collect(), key=lambda r: (r[0], r[1])):
        node = tree.nodes[ids[i][of]]
        node.side = n, np.frombuffer(x, np.int64)
        tree.split(ids[i][of], node.parts())
        ids[i] += node.below
    for j in (j for own_ids in ids.values() for j in own_ids):
        if not tree.nodes[j].below:
            tree.nodes[j].scatter = 0.0  # not to be split, or beyond the last split


def bisection(vectors: DataFrame, held: int = HELD, most: int = DIRECT) -> list[Node]:
    """Leaves of the bisection of all vectors, ``packed``: the leaf with the largest scatter is split next."""
    nothing, tasks, each = np.zeros(DIMS, np.float32), vectors.rdd.getNumPartitions(), np.dtype(np.int64).itemsize * DIMS
    tree = Tree(Node(0, nothing))
    tree = Tree(Node(*_looked(vectors, tree.placer(), {0: (nothing, False)}, tasks * each <= most).get(0, (0, nothing))))
    while wanted := tree.wanted():
        large = [i for i in wanted if tree.nodes[i].n > held]
        if not large:
            _split_whole(vectors, tree, wanted)
            continue
        directions = {i: (tree.nodes[i].v, tree.nodes[i].seeks) for i in large}
        for i, found in _looked(vectors, tree.placer(), directions, tasks * len(large) * each <= most).items():
            node = tree.nodes[i]
            if node.met(*found):
                if parts := node.parts():
                    tree.split(i, parts)
                else:
                    node.scatter = 0.0
    return tree.leaves()


def cluster(records: DataFrame, df: np.ndarray, n: int, sample: int | None = None, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """(idf, centres: leaves x DIMS), by the bisection of all documents and passes of k-means over them.

    Earlier callers give ``sample``; it has no effect, as nothing is sampled.
    """
    idf = (np.log((n + 1) / (df + 1)) * (df > 1)).astype(np.float32)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                yield packed(np.rint(vectors(*_part(part.slice(at, 500)), idf) * NORM))

    rows = written(records.select("f", "sizes").mapInArrow(send, "n int, x binary"), "subject-vectors")
    centres = _unit(np.stack([x.total for x in bisection(rows, held)]).astype(np.float32))
    for _ in range(PASSES):
        def add(sums: np.ndarray, p: pa.RecordBatch, centres: np.ndarray = centres) -> None:
            own = _rows(p).astype(np.float32)
            leaf = (own @ centres.T).argmax(axis=1)
            sums += (np.arange(len(centres))[:, None] == leaf) @ own

        sums = _added(rows, add, centres.shape)
        centres = np.where(np.any(sums, axis=1, keepdims=True), _unit(sums), centres)
    return idf, centres


def in_leaves(records: DataFrame, marked: DataFrame, idf: np.ndarray, centres: np.ndarray) -> DataFrame:
    """k, leaf, subjects (NULL if there are none) of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                p = part.slice(at, 500)
                leaf = (vectors(*_part(p), idf) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([p.column("k"), pa.array(leaf.astype(np.int32))], names=["k", "leaf"])

    return written(records.select("k", "f", "sizes").mapInArrow(run, "k long, leaf int").join(marked, "k", "left"), "leaves")


def leaf_mixtures(assigned: DataFrame, n_leaves: int) -> tuple[list[str], np.ndarray]:
    """(subjects, mixtures of the leaves with text on none last), counted over all documents."""
    sizes = np.zeros((n_leaves, 2))
    for leaf, n, marked in assigned.groupBy("leaf").agg(F.count("*"), F.count("subjects")).collect():
        sizes[leaf] = n, marked
    each = assigned.where("subjects IS NOT NULL").select("leaf", F.explode("subjects").alias("s"), (1 / F.size("subjects")).alias("part"))
    counts = each.groupBy("leaf", "s").agg(F.sum("part")).collect()
    subjects = sorted({r[1] for r in counts})
    of = {s: i for i, s in enumerate(subjects)}
    share = np.zeros((n_leaves, len(subjects)))
    for leaf, s, part in counts:
        share[leaf, of[s]] = part
    n, marked = sizes.T
    if not subjects:
        return [], share
    base, rate = share.sum(axis=0) / marked.sum(), marked.sum() / n.sum()
    # documents on no subject have no label: a leaf with fewer labels than its size lets expect is partly on none
    none = np.maximum(0.0, 1 - (marked + 1) / (rate * n + 1))
    own = (share + LEAF_PRIOR * base) / (marked + LEAF_PRIOR)[:, None]
    return subjects, np.hstack([(1 - none)[:, None] * own, none[:, None]])


def learn(records: DataFrame, labels: DataFrame, doc_id: str = "doc_id", sample: int | None = None) -> Model | None:
    """records: ``described`` documents; labels: doc_id, subject; sample: of earlier callers, without effect."""
    df, n = document_frequencies(records)
    marked = labels.where(F.col("subject").isNotNull()).groupBy(F.col(doc_id).cast("long").alias("k")).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    if not n or not marked.head(1):
        return None
    idf, centres = cluster(records, df, n)
    subjects, mixture = leaf_mixtures(in_leaves(records, marked, idf, centres), len(centres))
    if not subjects:
        return None
    width = len(subjects) + 1
    first = Model(subjects, np.zeros((BUCKETS, width)), idf, centres, mixture)
    top = np.argsort(-mixture, axis=1)[:, :TOP]
    shared = np.zeros_like(mixture)
    np.put_along_axis(shared, top, np.take_along_axis(mixture, top, axis=1), axis=1)

    def add_terms(counts: np.ndarray, p: pa.RecordBatch) -> None:
        """Terms of the documents of each leaf, to be shared among its subjects."""
        f, sizes, per_doc = _part(p)
        leaf = np.repeat(np.repeat(first.leaf(f, sizes, per_doc), per_doc), sizes)
        np.add.at(counts.reshape(-1), f * len(centres) + leaf, np.uint32(1))

    slim = records.select("f", "sizes")
    odds = lambda counts: _log_odds(counts, counts.sum(axis=1, dtype=float))
    model = Model(subjects, odds(_added(slim, add_terms, (BUCKETS, width), shared)), idf, centres, mixture)

    def add_sentences(sums: np.ndarray, p: pa.RecordBatch) -> None:
        """Terms of each sentence, given to its subject; below them, words of the subjects by leaf."""
        f, sizes, per_doc = _part(p)
        leaf = model.leaf(f, sizes, per_doc)
        words = (sizes + 1) / 2
        resp, _ = mixtures(_by_sentence(model.weights, f, np.cumsum(sizes) - sizes), words, np.cumsum(per_doc) - per_doc, model.mixture[leaf] + FLOOR)
        best = resp.argmax(axis=1)
        weight = resp[np.arange(len(resp)), best]
        np.add.at(sums.reshape(-1), f * width + np.repeat(best, sizes), np.repeat(weight, sizes))
        np.add.at(sums[BUCKETS:].reshape(-1), np.repeat(leaf, per_doc) * width + best, words * weight)

    counts = _added(slim, add_sentences, (BUCKETS + len(centres), width))
    said = counts[BUCKETS:].astype(float)
    mixture = (said + mixture) / np.maximum(said.sum(axis=1, keepdims=True) + mixture.sum(axis=1, keepdims=True), 1e-12)
    return Model(subjects, odds(counts[:BUCKETS]), idf, centres, mixture)


def areas(records: DataFrame, model: Model | None, doc_id: str = "doc_id", least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, share) of the subjects that make up at least ``least`` of a document."""
    schema = pa.schema([("k", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows if model is not None else 0, 500):
                p = part.slice(at, 500)
                f, sizes, per_doc = _arrays(p.column(1).to_pylist(), p.column(2).to_pylist())
                share = model.shares(f, sizes, per_doc)
                d, j = np.nonzero(share >= least)
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(d)), pa.array([model.subjects[x] for x in j], pa.string()), pa.array(share[d, j])], schema=schema)

    return records.select("k", "f", "sizes").mapInArrow(run, "k long, subject string, share double").withColumnRenamed("k", doc_id)
