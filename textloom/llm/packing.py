"""Problem 7: filling containers of fixed capacity, by a configuration linear program over the length histogram.

Only the histogram of lengths reaches the driver: at most one number per length up to the capacity. Lengths are grouped
and rounded up; the program "fewest containers such that every group is covered" over all ways to fill one container is
solved by multiplicative weights, whose pricing step is a knapsack dynamic program. Its solution, scaled so that it holds
``LAID`` of the tokens there are and rounded along its running total, is a plan "m containers with these counts of these
groups". What rounding leaves tops up the room that is really left, best fit, still on histograms. Items find their
place in the plan by their rank among the items of their length, so no task ever holds a whole length or container.

An item over the capacity is cut: full containers, and a rest that is an item. Items of size 0 take no room and lie in
container 0. NULL texts count as ''. Repeated rows are items of their own.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Groups of lengths, rounds of the program, units of the capacity in its pricing, and the share by which a round covers a group at most.
GROUPS, ROUNDS, GRID, STEP = 96, 400, 1024, 0.05
#: Share of the program's containers that are laid; with all of them, lengths that it covers too often would leave room.
LAID = 0.9
#: Items of one length that one task numbers, about.
RANKED = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    """Loaded once in each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str) -> Callable[[str | None], int]:
    """A function from texts to token counts."""
    encoding = _encoding(path)
    return lambda text: len(encoding.encode_ordinary(text)) if text else 0


def token_sums(path: str = TOKENIZER) -> Callable[[str], list[int]]:
    """A function from a text to the tokens that begin before each of its offsets."""

    def sums(text: str) -> list[int]:
        encoding = _encoding(path)
        _, starts = encoding.decode_with_offsets(encoding.encode_ordinary(text))
        return np.searchsorted(np.array(starts), np.arange(len(text) + 1), side="left").tolist()

    return sums


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row."""
    schema = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([count(t) for t in part.column(1).to_pylist()], pa.int64())], schema=schema)

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, n_tokens long").withColumnRenamed("k", key)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size (any number of times) for the largest value within the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fit = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fit[c]:
            with_one = best[c - s[:n]] + v[:n]
            i = int(with_one.argmax())
            if with_one[i] > best[c]:
                best[c], choice[c] = with_one[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= s[choice[c]]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """(counts of sizes in a container, number of such containers): the cover of the demand by multiplicative weights, scaled
    to the volume of the demand."""
    if not len(sizes):
        return []
    unit = max(1, -(-capacity // GRID))
    grid_sizes, grid = -(-sizes // unit), capacity // unit
    grid_sizes = np.minimum(grid_sizes, grid)
    weights = sizes * demand / (sizes * demand).max()  # prices by size: what is optimal if nothing is wasted
    used: dict[bytes, list] = {}
    covered = np.zeros(len(sizes))
    for _ in range(rounds):
        pick = knapsack(grid_sizes, weights / demand, grid)
        if not pick.any():
            break
        gain = pick / demand
        amount = step / gain.max()  # the best covered size advances by this share
        entry = used.setdefault(pick.tobytes(), [pick, 0.0])
        entry[1] += amount
        covered += amount * gain
        weights *= np.exp(-amount * gain)
        weights /= weights.max()
        if covered.min() >= 1:
            break
    volume = sizes * demand
    scale = volume.sum() / max(float((covered * volume).sum()), 1e-9)
    return [(pick, amount * scale) for pick, amount in used.values()]


class Plan:
    """Blocks of equal containers, and for each length the ranks that go to each block."""

    def __init__(self, capacity: int, histogram: dict[int, int]):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.blocks: list[list] = []  # first container, containers, room left in each
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first rank, end rank, first container, items per container
        self.containers = 0
        self.by_program = 0  # tokens that the program's configurations place

    def open(self, n: int) -> int:
        self.blocks.append([self.containers, n, self.capacity])
        self.containers += n
        return len(self.blocks) - 1

    def put(self, block: int, size: int, per: int) -> None:
        first, n, room = self.blocks[block]
        at = self.taken[size]
        self.places.append((size, at, at + n * per, first, per))
        self.taken[size] += n * per
        self.left[size] -= n * per
        if not self.left[size]:
            del self.left[size]
        self.blocks[block][2] = room - per * size

    def split(self, block: int, n: int) -> int:
        """The last n containers of a block as a block of their own."""
        first, m, room = self.blocks[block]
        self.blocks[block][1] = m - n
        self.blocks.append([first + m - n, n, room])
        return len(self.blocks) - 1


def _fill(plan: Plan, block: int, lengths: list[int]) -> None:
    """Best fit: the largest lengths that the block's room takes; a block with more containers than items is divided."""
    pending = [block]
    while pending:
        block = pending[-1]
        i = bisect_right(lengths, plan.blocks[block][2])
        if not i:
            pending.pop()
            continue
        size = lengths[i - 1]
        have, n = plan.left[size], plan.blocks[block][1]
        if have < n:
            rest = plan.split(block, n - have)
            plan.put(block, size, 1)
            lengths.pop(i - 1)
            pending.insert(-1, rest)
            continue
        plan.put(block, size, min(have // n, plan.blocks[block][2] // size))
        if size not in plan.left:
            lengths.pop(i - 1)


def make_plan(histogram: dict[int, int], capacity: int, program: bool = True) -> Plan:
    """A plan for items of 1 … capacity, from how many there are of each length; without the program, by best fit alone."""
    plan = Plan(capacity, histogram)
    sizes = np.array(sorted(plan.left), np.int64)
    if len(sizes) and program:
        n = np.array([plan.left[s] for s in sizes.tolist()], np.int64)
        volume = np.cumsum(n)
        group = np.minimum((volume - 1) * GROUPS // volume[-1], GROUPS - 1)  # groups of equal numbers of items
        tops = np.array([sizes[group == g].max() for g in np.unique(group)])
        demand = np.array([n[group == g].sum() for g in np.unique(group)], float)
        members = [sizes[group == g].tolist() for g in np.unique(group)]
        total, laid = 0.0, 0
        for pick, amount in sorted(configurations(tops, demand, capacity), key=lambda x: -x[1]):
            total += LAID * amount
            if pick.sum() > 1:
                pick[np.nonzero(pick)[0][0]] -= 1  # the smallest item is chosen last, to fit the room that is really left
            _lay(plan, pick, round(total) - laid, members)
            laid = round(total)
    plan.by_program = sum((b - a) * s for s, a, b, _, _ in plan.places)
    lengths = sorted(plan.left)
    for block in range(len(plan.blocks)):
        _fill(plan, block, lengths)
    while lengths:  # what rounding left, largest first
        size = lengths[-1]
        _fill(plan, plan.open(max(1, plan.left[size] // (capacity // size))), lengths)
    return plan


def _lay(plan: Plan, pick: np.ndarray, amount: int, members: list[list[int]]) -> None:
    """``amount`` containers of a configuration, each count taken from the longest lengths of its group that remain."""
    pending = [(amount, [(g, int(k)) for g, k in enumerate(pick) if k], None)]
    while pending:
        n, needs, block = pending.pop()
        if n <= 0 or not needs:
            continue
        (g, k), *rest = needs
        while members[g] and members[g][-1] not in plan.left:
            members[g].pop()
        if not members[g]:
            pending.append((n, rest, block))  # the group is used up; its room is topped up later
            continue
        size = members[g][-1]
        have = plan.left[size]
        if block is None:
            if have < n * 1:
                pending.append((n - have, needs, None))
                n = have
            block = plan.open(n)
        elif have < n:
            other = plan.split(block, n - have)
            pending.append((n - have, needs, other))
            n = have
        per = min(k, have // n)
        plan.put(block, size, per)
        pending.append((n, ([(g, k - per)] if k > per else []) + rest, block))


def _ranked(sized: DataFrame, size: str, key: str, histogram: dict[int, int]) -> DataFrame:
    """0-based rank of each item among the items of its size; a size with many items is divided among as many tasks as they need."""
    many = [(s, -(-n // RANKED)) for s, n in histogram.items() if n > RANKED]
    salts = sized.sparkSession.createDataFrame(many, f"{size} long, salts int")  # at most capacity rows
    salted = sized.join(F.broadcast(salts), size, "left").withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    counts = salted.groupBy(size, "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(size).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(size, "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(size, "salt").orderBy(key, "part")) - 1
    return salted.join(offsets, [size, "salt"]).withColumn("rank", F.col("before") + own).drop("salt", "before")


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, size, container_id): a row for each item; a cut item has a row for each part, counted from 0."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = written(sizes.select(F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("s")), "sizes")
    full = F.floor((F.col("s") - 1) / capacity).cast("int")
    whole = F.when(F.col("s") > capacity, full).otherwise(0)
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), whole)))
    parts = parts.withColumn("s", F.when(F.col("part") < whole, F.lit(capacity)).otherwise(F.col("s") - whole * capacity))
    histogram = {int(s): int(n) for s, n in parts.where("s > 0").groupBy("s").count().collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity)
    places = np.array(sorted(plan.places), np.int64).reshape(-1, 5)
    base = int(max((p[2] for p in plan.places), default=0)) + 1
    starts = places[:, 0] * base + places[:, 1]
    schema = pa.schema([("k", pa.int64()), ("part", pa.int32()), ("s", pa.int64()), ("container_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, rank = b.column("s").to_numpy(), b.column("rank").to_numpy()
            at = np.maximum(np.searchsorted(starts, s * base + rank, side="right") - 1, 0)
            where = places[at, 3] + (rank - places[at, 1]) // np.maximum(places[at, 4], 1) if len(places) else s * 0
            where = np.where(s > 0, where, 0)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("part"), b.column("s"), pa.array(where, pa.int64())], schema=schema)

    ranked = _ranked(parts.where("s > 0"), "s", "k", histogram).select("k", "part", "s", F.col("rank").cast("long").alias("rank"))
    empty = parts.where("s <= 0").select("k", "part", "s", F.lit(0).cast("long").alias("container_id"))
    out = ranked.mapInArrow(run, "k long, part int, s long, container_id long").unionByName(empty)
    return out.withColumnsRenamed({"k": key, "s": size})
