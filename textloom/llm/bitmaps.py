"""A fixed-size bitmap of 64-bit hashes: a filter that may pass strangers and never drops a member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: 256 KB, however many hashes there are.
BITS = 1 << 21
_SCHEMA = pa.schema([("slot", pa.int32()), ("bits", pa.int64())])


def _bits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        spot = mix(part.column(0).to_numpy().view(np.uint64)) % np.uint64(BITS)
        one = (np.uint64(1) << (spot & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int32)), pa.array(one)], schema=_SCHEMA)


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Of a one-column frame of longs without NULL; at most BITS / 64 numbers reach the driver."""
    out = np.zeros(BITS // 64, np.uint64)
    for slot, b in hashes.mapInArrow(_bits, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect():
        out[slot] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return out


def members(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members."""
    spot = mix(hashes) % np.uint64(BITS)
    return (bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
