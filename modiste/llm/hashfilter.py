"""Two Bloom filters, for hashes seen once and seen twice, built over all rows.

Every task fills its own pair; pairs merge as `twice = a.twice | b.twice | (a.once & b.once)`, `once = a.once | b.once`, so a hash that two
tasks have seen is in the merged twice-filter for certain. What may go wrong is a false alarm, never a miss: whatever a caller does
with a hash that passes must confirm it. The filters have a fixed number of bits, a parameter, so what is sent around has a fixed size;
with more data than they were made for, more hashes pass and more rows are confirmed, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modiste.llm.common import give_back, small_batches

#: bits of one segment, the unit in which filters travel and merge
SEGMENT = 1 << 16


def positions(hashes: np.ndarray, bits: int, k: int) -> list[np.ndarray]:
    """The k bits of each 64-bit hash; `bits` is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(k)]


def packed(part: np.ndarray) -> bytes:
    """A segment (a bit map) as its set bits, two bytes each, or as it is where that is shorter."""
    used = np.flatnonzero(part)
    bits = np.unpackbits(part[used], bitorder="little")
    if 2 * np.count_nonzero(bits) >= SEGMENT // 8:
        return part.tobytes()
    at = np.flatnonzero(bits)
    return (used[at >> 3] << 3 | at & 7).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT // 8:
        return np.frombuffer(data, np.uint8)
    if not data:
        return np.zeros(SEGMENT // 8, np.uint8)
    flags = np.zeros(SEGMENT, bool)
    flags[np.frombuffer(data, "<u2")] = True
    return np.packbits(flags, bitorder="little")


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def put(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


class Twice:
    """The merged filter of hashes seen at least twice."""

    def __init__(self, data: bytes, bits: int, k: int):
        self.data, self.bits, self.k = np.frombuffer(data, np.uint8), bits, k

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in positions(hashes, self.bits, self.k):
            out &= held(self.data, p)
        return out


def seen_twice(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int, k: int) -> Twice:
    """The filter of what `hashes` yields at least twice over all batches of `df`."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            distinct, n = np.unique(hashes(batch), return_counts=True)
            at = positions(distinct, bits, k)
            again = np.logical_and.reduce([held(once, p) for p in at]) | (n > 1)
            for p in at:
                put(twice, p[again])
                put(once, p)
            if batch.nbytes > 1 << 20:
                give_back()
        size = SEGMENT // 8
        used = [a for a in range(0, bits // 8, size) if once[a : a + size].any()]
        for i in range(0, len(used), 64):
            rows = [(a // size, packed(once[a : a + size]), packed(twice[a : a + size])) for a in used[i : i + 64]]
            s, o, t = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(o, pa.binary()), pa.array(t, pa.binary())], ["segment", "once", "twice"])

    def merge(batches):
        merged: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = unpacked(o), unpacked(t)
                if s in merged:
                    a, b = merged[s]
                    b |= t | (a & o)
                    a |= o
                else:
                    merged[s] = [o.copy(), t.copy()]
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([t.tobytes() for _, t in merged.values()], pa.binary())], ["segment", "twice"])

    parts = df.mapInArrow(fill, "segment int, once binary, twice binary").repartition("segment").mapInArrow(merge, "segment int, twice binary")
    data = bytearray(bits // 8)
    with small_batches(df.sparkSession):
        for row in parts.collect():  # bits / 8 bytes at most
            data[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = row.twice
    return Twice(bytes(data), bits, k)
