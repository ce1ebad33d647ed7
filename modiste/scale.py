"""Size checks and skew-proof building blocks used by every operator.

* a group may hold a third of all rows, so a full numbering of a group never relies on one task holding it;
* "first k per group" goes through `row_number() <= k`, which Spark turns into a per-task group limit before the shuffle;
* group statistics of large inputs are `groupBy` aggregates (map-side combine) joined back, not whole-partition windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste.session import cut

#: below this many input bytes one sorted task may hold a whole group; above it numbering is spread by range
SPREAD_BYTES = 512 << 20


def leaf_bytes(df: DataFrame) -> int:
    """Bytes read by the leaves of the optimised plan (no job is run)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread_small(df: DataFrame, at_least: int = 100 << 10, at_most: int = 1 << 30) -> DataFrame:
    """Use all cores on a small table that sits in fewer files than there are cores. Tables of many files, and tables too
    small or too large for it to pay, are left alone."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if at_least <= leaf_bytes(df) <= at_most and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def broadcast_measured(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """`df`, stored, and sent to every task if what it holds was measured to be at most `limit` bytes; else joined as Spark sees fit."""
    df = cut(df)
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, spread: bool | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its group; `order` must be total.

    Small inputs use one window. Large inputs, and numberings without keys, are range-partitioned on (keys, order): each
    task numbers its own slice and the slices' start offsets come from a count per (key, slice), so a hot group is
    shared by many tasks.
    """
    order = as_columns(order)
    if spread is None:
        spread = not keys or leaf_bytes(df) > SPREAD_BYTES
    if not spread:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    slot = f"__{out}_slice"
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(slot, F.spark_partition_id()))
    counts = ranged.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(slot).alias("__slot"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    match = ranged[slot] == starts["__slot"]
    for i, k in enumerate(keys):
        match = match & ranged[k].eqNullSafe(starts[f"__k{i}"])
    local = F.row_number().over(Window.partitionBy(slot, *keys).orderBy(*order))
    joined = ranged.withColumn(out, local.cast("long"))
    match = joined[slot] == starts["__slot"]
    for i, k in enumerate(keys):
        match = match & joined[k].eqNullSafe(starts[f"__k{i}"])
    return joined.join(starts, match).withColumn(out, F.col(out) + F.col("__start")).select(*df.columns, out)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group with their 1-based position in `out`."""
    w = Window.partitionBy(*keys).orderBy(*as_columns(order))
    ranked = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= F.lit(int(k)))
    return ranked.withColumn(out, F.col(out).cast("long"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return first_k(df, keys, order, 1, "__first").drop("__first")


def with_group_stats(df: DataFrame, keys: Sequence[str], spread: bool | None = None, **aggs: Column) -> DataFrame:
    """Attach per-group aggregates. Small inputs use windows (one shuffle). Large inputs are materialised once, aggregated with
    map-side combine and joined back, so a hot group is never brought into one task."""
    if spread is None:
        spread = leaf_bytes(df) > SPREAD_BYTES
    if not spread:
        w = Window.partitionBy(*keys)
        return df.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
    df = cut(df)
    stats = df.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in aggs.items()])
    cond = None
    for i, k in enumerate(keys):
        eq = F.col(k).eqNullSafe(F.col(f"__g{i}"))
        cond = eq if cond is None else cond & eq
    return df.join(stats, cond, "left").drop(*[f"__g{i}" for i in range(len(keys))])


#: bits of a bucket of Spark's bitmap functions, and the most and fewest buckets of a filter: at most 32 MB are sent to every task
BITMAP_BITS, MOST_BUCKETS, FEWEST_BUCKETS = 32768, 8192, 32


def bitmap_of(keys: Sequence[Column], rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits): a bit for the hash of each row's keys, made by Spark's bitmap aggregate."""
    spot = F.pmod(F.xxhash64(*keys), F.lit(buckets * BITMAP_BITS)) + 1
    return rows.select(F.bitmap_bucket_number(spot).alias("__bucket"), F.bitmap_bit_position(spot).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def with_suspicion(df: DataFrame, keys: Sequence[Column], bitmap: DataFrame, buckets: int, out: str) -> DataFrame:
    """`df` with a boolean column: whether the bit of the row's keys is set. The bitmap has a row per bucket and a fixed size; no row is shuffled."""
    spot = F.pmod(F.xxhash64(*keys), F.lit(buckets * BITMAP_BITS)) + 1
    marked = df.withColumn("__at", F.bitmap_bit_position(spot)).withColumn("__bucket", F.bitmap_bucket_number(spot))
    met = marked.join(F.broadcast(bitmap), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(out, F.coalesce(F.bit_get(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))).drop("__at", "__bucket", "__bits")


def _suspected(df: DataFrame, seen: DataFrame, keys: Sequence[str], filtered: bool | None) -> DataFrame | None:
    """`df` with `__suspect`, by a bitmap of hashes with eight bits for each row of `seen` as far as it may grow; None where `seen` is small, so that Spark
    sends it to every task as it is, or `filtered` is False."""
    spark = df.sparkSession
    if filtered is None:
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        filtered = leaf_bytes(seen) > int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) if not limit.lstrip("-").isdigit() else limit)
    if not filtered:
        return None
    buckets, n = FEWEST_BUCKETS, seen.count()
    while buckets < MOST_BUCKETS and buckets * BITMAP_BITS < 8 * n:
        buckets *= 2
    types = dict(df.dtypes)
    alike = [F.col(k).cast(types[k]) for k in keys]  # one hash for either side
    return with_suspicion(df, alike, cut(bitmap_of(alike, seen, buckets)), buckets, "__suspect")


def without(df: DataFrame, seen: DataFrame, keys: Sequence[str], filtered: bool | None = None) -> DataFrame:
    """Rows of `df` whose keys `seen` hasn't.

    What `seen` holds is first noted in a bitmap of hashes, eight bits for each of its rows as far as the bitmap may grow. Rows whose bit isn't set pass
    without a shuffle; the others, those seen and an eighth of the rest at most, are compared exactly. `df` is scanned once for either. Small `seen`, which
    Spark sends to every task as it is, and `filtered=False` go without the bitmap."""
    keys = list(keys)
    seen = seen.select(*keys)
    rows = _suspected(df, seen, keys, filtered)
    if rows is None:
        return df.join(seen, keys, "left_anti")
    return rows.where(~F.col("__suspect")).drop("__suspect").unionByName(rows.where("__suspect").drop("__suspect").join(seen, keys, "left_anti"))


def within(df: DataFrame, seen: DataFrame, keys: Sequence[str], filtered: bool | None = None) -> DataFrame:
    """Rows of `df` whose keys `seen` has; those that the bitmap of `without` rules out are dropped before the shuffle."""
    keys = list(keys)
    seen = seen.select(*keys)
    rows = _suspected(df, seen, keys, filtered)
    return (df if rows is None else rows.where("__suspect").drop("__suspect")).join(seen, keys, "left_semi")


def bounded_rows(df: DataFrame, max_rows: int):
    """Collect `df` as an Arrow table if it has at most `max_rows` rows, else None. Never brings more to the driver."""
    table = df.limit(max_rows + 1).toArrow()
    return None if table.num_rows > max_rows else table
