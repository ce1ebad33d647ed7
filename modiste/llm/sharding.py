"""Minimax contiguous partition of documents into shards, with DataFrame operations only.

Documents with equal texts form a group that no cut may split. Groups keep the order of their smallest doc_id. The smallest feasible
shard capacity is found by binary search, each try filling shards greedily, and the order is cut there. Where capacity leaves a choice,
a cut goes to the place that shares the rest evenly.

A greedy try needs few of the group starts, so none brings them all to the driver: bytes are summed per range slice, and the driver
holds, per cell of the byte axis, the first and last group start in it (a fixed number of cells). Lookups inside a cell give a lower and
an upper bound, the search runs on both, and only cells that leave it open are read finer, until lower and upper agree.

Null texts have no bytes and count as empty texts. Rows that repeat a doc_id are placed each. Without rows there are no shards. A row must
weigh something, so `overhead` is at least 1.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modiste.llm.common import stored

#: cells of the byte axis held on the driver; finer ones per cell that is read again
CELLS, FINER = 1 << 14, 1 << 8


def numbered(docs: DataFrame, overhead: int) -> DataFrame:
    """Per document its group, the bytes and rows before it, written: (doc_id, size, text_crc32, at, place, start), where `at` counts the bytes before
    the row and `start` those before its group, in the order of groups."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = stored(rows, "shard-rows")
    groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "shard-groups")
    rows = rows.join(groups, "digest")
    order = [F.col("first").asc_nulls_first(), F.col("digest"), F.col("doc_id").asc_nulls_first()]
    rows = stored(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "shard-slices")
    inside = Window.partitionBy("slice").orderBy(*order)
    slices = rows.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    slices = slices.select("slice", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    rows = rows.withColumn("in_bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = rows.withColumn("in_rows", F.row_number().over(inside) - 1).join(slices, "slice")
    rows = rows.select("doc_id", "size", "text_crc32", "digest", (F.col("bytes_before") + F.col("in_bytes")).alias("at"), (F.col("rows_before") + F.col("in_rows")).cast("long").alias("place"))
    return stored(rows, "shard-order")


class Starts:
    """What the driver knows of the group starts: points, and which gaps between neighbours may hide more."""

    def __init__(self, starts: DataFrame, total: int):
        self.starts, self.total = starts, total
        self.shift = max(0, total.bit_length() - CELLS.bit_length() + 1)
        self.points: list[int] = []
        self.hidden: dict[int, int] = {}  # first point of an open gap: shift of its cell
        self.open: set[int] = set()
        self._read(starts, self.shift)
        if total not in self.points[-1:]:
            self.points.append(total)

    def _read(self, starts: DataFrame, shift: int) -> None:
        cells = starts.groupBy(F.shiftright("start", shift).alias("cell")).agg(F.min("start").alias("a"), F.max("start").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        self.points = sorted({*self.points, *(r.a for r in cells), *(r.b for r in cells)})
        self.hidden |= {r.a: shift for r in cells if r.n > 2}

    def refine(self) -> None:
        """Read the cells of all gaps that lookups have found open."""
        by_shift: dict[int, set[int]] = {}
        for a in self.open:
            by_shift.setdefault(self.hidden.pop(a), set()).add(a)
        self.open = set()
        for shift, points in by_shift.items():
            cells = sorted({p >> shift for p in points})
            self._read(self.starts.where(F.shiftright("start", shift).isin(cells)), max(0, shift - FINER.bit_length() + 1))

    def last_to(self, x: int) -> tuple[int, int]:
        """Bounds of the last start that is at most x."""
        i = bisect.bisect_right(self.points, x) - 1
        a = self.points[i]
        if x == a or a not in self.hidden:
            return a, a
        self.open.add(a)
        return a, x

    def first_from(self, x: int) -> tuple[int, int]:
        """Bounds of the first start that is at least x."""
        i = bisect.bisect_left(self.points, x)
        b = self.points[i]
        if x == b or i == 0 or self.points[i - 1] not in self.hidden:
            return b, b
        self.open.add(self.points[i - 1])
        return x, b

    def reach(self, capacity: int, shards: int) -> tuple[int, int]:
        """Bounds of where greedy filling ends."""
        lo = hi = 0
        for _ in range(shards):
            lo, hi = self.last_to(min(lo + capacity, self.total))[0], self.last_to(min(hi + capacity, self.total))[1]
        return lo, hi


def smallest_capacity(starts: Starts, shards: int) -> int:
    low, high = (starts.total - 1) // shards, starts.total  # low doesn't do, high does

    def bounds(side: int) -> int:
        """The smallest capacity that does, going by one bound of every lookup; gaps that leave a try open are noted."""
        no, yes = low, high
        while yes - no > 1:
            mid = (yes + no) // 2
            starts.open = set()
            ends = starts.reach(mid, shards)
            if ends[0] < starts.total <= ends[1]:
                undecided.update(starts.open)
            no, yes = (no, mid) if ends[side] >= starts.total else (mid, yes)
        return yes

    while True:
        undecided: set[int] = set()
        low, high = bounds(1) - 1, bounds(0)
        if high - low == 1:
            return high
        starts.open = undecided
        starts.refine()


def cuts(starts: Starts, capacity: int, shards: int) -> list[int]:
    """Where shards 1, 2, ... begin: no shard over `capacity`; within that, the rest is shared evenly."""
    while True:
        starts.open = set()
        least = [starts.total] * (shards + 1)  # where shard k may begin at the earliest, so that the rest fits
        for k in range(shards - 1, 0, -1):
            least[k] = starts.first_from(max(0, least[k + 1] - capacity))[0]
        out, at = [], 0
        for k in range(1, shards):
            fair = at + round((starts.total - at) / (shards - k + 1))
            down, up = starts.last_to(fair)[0], starts.first_from(fair)[1]
            near = up if down == at or up - fair < fair - down else down
            at = min(max(near, least[k]), starts.last_to(min(at + capacity, starts.total))[0])
            out.append(at)
        if not starts.open:
            return out
        starts.refine()


def sharded(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, by bytes."""
    rows = numbered(docs, overhead)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = stored(rows.groupBy("digest").agg(F.min("at").alias("start")).select("start"), "shard-starts")
    begins = []
    if total:
        known = Starts(starts, total)
        begins = cuts(known, smallest_capacity(known, shards), shards)
    shard = sum((F.when(F.col("at") >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard)
    first = dict(placed.groupBy("shard").agg(F.min("place")).collect())  # a row per shard
    slot = F.col("place")
    for s, p in first.items():
        slot = F.when(F.col("shard") == s, F.col("place") - p).otherwise(slot)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
