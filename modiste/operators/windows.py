"""Array loops of the feed as windows. Numbering goes through `numbered`, so no operator needs a whole hot group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions.text import clean
from modiste.scale import first_k, first_per_key, numbered, with_group_stats

C = F.col
OTHER = "__unknown__"


def znorm(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    """(x-mean)/population deviation per pool; missing or flat pools give 0."""
    s = with_group_stats(df, keys, __mean=F.avg(score), __std=F.stddev_pop(score))
    value = F.when(C(score).isNull() | (C("__std") < 1e-9), F.lit(0.0)).otherwise((C(score) - C("__mean")) / C("__std"))
    return s.withColumn(out, value).drop("__mean", "__std")


def _rank_value(score: str, rk: Column, n: Column) -> Column:
    return F.when(C(score).isNull(), F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise((rk - 1) / (n - 1))


def ranknorm(df: DataFrame, keys: Sequence[str], score: str, out: str, order: Sequence[str | Column]) -> DataFrame:
    """Ascending position/(n-1) among non-null scores; a lone score gives 1, a missing one 0. `order` breaks ties."""
    ranked = numbered(df, keys, [C(score).asc_nulls_last(), *order], "__rk")
    n = with_group_stats(ranked, keys, __n=F.count(score))
    return n.withColumn(out, _rank_value(score, C("__rk"), C("__n"))).drop("__rk", "__n")


def adaptive_norm(df: DataFrame, keys: Sequence[str], score: str, out: str, order: Sequence[str | Column], min_pool: int = 30) -> DataFrame:
    """z-norm for pools with at least `min_pool` scores, else rank-norm."""
    s = with_group_stats(df, keys, __n=F.count(score), __mean=F.avg(score), __std=F.stddev_pop(score))
    s = numbered(s, keys, [C(score).asc_nulls_last(), *order], "__rk")
    z = F.when(C(score).isNull() | (C("__std") < 1e-9), F.lit(0.0)).otherwise((C(score) - C("__mean")) / C("__std"))
    return s.withColumn(out, F.when(C("__n") >= min_pool, z).otherwise(_rank_value(score, C("__rk"), C("__n")))).drop("__n", "__mean", "__std", "__rk")


def adaptive_norm_column(score: Column, keys: Sequence[str], order: Sequence[str | Column], min_pool: int = 30) -> Column:
    """The same as one window expression, for pools of bounded size (all norms of a pool then share one shuffle)."""
    w = Window.partitionBy(*keys)
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_pop(score).over(w)
    rk = F.row_number().over(w.orderBy(score.asc_nulls_last(), *order))
    z = F.when(std < 1e-9, F.lit(0.0)).otherwise((score - mean) / std)
    return F.when(score.isNull(), F.lit(0.0)).when(n >= min_pool, z).when(n == 1, F.lit(1.0)).otherwise((rk - 1) / (n - 1))


def cap_per_group(df: DataFrame, caps: Sequence[tuple[Sequence[str], int]], order: Sequence[str | Column]) -> DataFrame:
    """Successive caps, each in rank order over what the one before left."""
    for keys, cap in caps:
        df = first_k(df, keys, order, cap, "__cap").drop("__cap")
    return df


def global_first_category(df: DataFrame, keys: Sequence[str], categories: Sequence[str] = tuple(vocab.CATEGORIES), order: Sequence[str] = ("pos",)) -> DataFrame:
    """A product stays only in the first category (in list order) that has it."""
    ordinal = F.array_position(F.array(*[F.lit(c) for c in categories]), C("category"))
    return first_per_key(df.withColumn("__ord", ordinal), [*keys, "object_id"], ["__ord", *order]).drop("__ord")


def brand_key(brand: Column, retailer: Column) -> Column:
    k = clean(F.coalesce(brand, retailer, F.lit("")))
    return F.when(k == "", OTHER).otherwise(k)


def round_robin(df: DataFrame, keys: Sequence[str], bucket: str, pos: str = "pos", out: str = "new_pos", tie: str = "object_id") -> DataFrame:
    """Interleave buckets: the n-th items of all buckets, buckets in order of first appearance."""
    inner = numbered(df, [*keys, bucket], [pos, tie], "__rn")
    first = with_group_stats(inner, [*keys, bucket], __first=F.min(F.struct(pos, tie)))
    return numbered(first, keys, ["__rn", "__first", tie], out).drop("__rn", "__first")


def round_robin_2level(df: DataFrame, keys: Sequence[str], outer: str, inner: str, pos: str = "pos", out: str = "new_pos", tie: str = "object_id") -> DataFrame:
    """Inner buckets interleaved within each outer bucket, then outer buckets interleaved."""
    queue = round_robin(df, [*keys, outer], inner, pos, "__q", tie)
    first = with_group_stats(queue, [*keys, outer], __first=F.min(F.struct(pos, tie)))
    return numbered(first, keys, ["__q", "__first"], out).drop("__q", "__first")


BAND_EDGES = [1, 0.7, 0.4, 0.2, 0.08, 0]


def price_band_sample(df: DataFrame, cap: float, per_band: int = math.ceil(384 / 5), keys: Sequence[str] = (), tie: str = "object_id", out: str = "new_pos") -> DataFrame:
    """Five price bands below the cap, the dearest items of each, interleaved from the top band down."""
    edges = [cap * e for e in BAND_EDGES]
    band = None
    for i in range(len(edges) - 1):
        low = (C("price") > edges[i + 1]) if edges[i + 1] > 0 else F.lit(True)
        hit = low & (C("price") <= edges[i])
        band = F.when(hit, i) if band is None else band.when(hit, i)
    banded = df.withColumn("band", band).where("band IS NOT NULL")
    kept = first_k(banded, [*keys, "band"], [C("price").desc(), tie], per_band, "rn")
    return numbered(kept, keys, ["rn", "band"], out, spread=False if not keys else None)


def catalog_slices(df: DataFrame, order: Sequence[str | Column], page: int, slices: int = 8, per_page: int = 96, out: str = "new_pos") -> DataFrame:
    """Evenly spaced slices of the ranked catalogue, interleaved. The ranking is numbered by range, never in one task."""
    per_slice = per_page // slices
    total = df.count()
    span = max(1, total // (slices * per_slice))
    ranked = numbered(df, [], order, "__p")
    p0 = C("__p") - 1
    block, within = F.floor(p0 / per_slice), p0 % per_slice
    which = (block - page) / span
    wanted = ranked.where(block.isin([s * span + page for s in range(slices)]))
    # a block belongs to slice (block - page) / span; the blocks are few and distinct
    spot = wanted.withColumn("__w", within).withColumn("__s", which.cast("long"))
    return numbered(spot, [], ["__w", "__s"], out, spread=False).drop("__p", "__w", "__s")


def rank_fraction(df: DataFrame, keys: Sequence[str], pos: str = "pos", out: str = "fraction") -> DataFrame:
    """1 - i/(n-1) inside the group; a single row gives 1."""
    n = with_group_stats(numbered(df, keys, [pos, "object_id"], "__rk"), keys, __n=F.count(F.lit(1)))
    return n.withColumn(out, F.when(C("__n") == 1, F.lit(1.0)).otherwise(1 - (C("__rk") - 1) / (C("__n") - 1))).drop("__rk", "__n")


def weighted_recency_hits(signals: DataFrame, attributes: Sequence[str], user: str = "user_token", recent: int = 3, weight: int = 2) -> DataFrame:
    """Hits per (user, attribute, value): the newest three entries of the history count double.

    Counts are plain aggregates; only the newest `recent` rows per user are ranked."""
    def long(df):
        return df.select(user, *[F.lower(c).alias(c) for c in attributes]).unpivot([user], list(attributes), "feature", "value").where("value <> ''")

    newest = first_k(signals, [user], [C("ts").desc(), C("event_id").desc()], recent, "__rn")
    parts = long(signals).withColumn("hits", F.lit(1)).unionByName(long(newest).withColumn("hits", F.lit(weight - 1)))
    return parts.groupBy(user, "feature", "value").agg(F.sum("hits").alias("hits"))


def diversity_slots(boosted: DataFrame, exploratory: DataFrame, keys: Sequence[str], start: int = 16, run: int = 3, pos: str = "pos") -> DataFrame:
    """From slot `start` on one exploratory item after every three ranked ones, in closed form; short pages stay as they are."""
    nb = boosted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nb"))
    ne = exploratory.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ne"))
    b = boosted.join(ne, list(keys), "left").withColumn("__e", F.coalesce("__ne", F.lit(0))).join(nb, list(keys))
    active = (C("__e") > 0) & (C("__nb") > start)
    i = C(pos) - 1 - start
    slot = F.when(active & (i >= 0), start + i + F.least(F.floor(i / run), C("__e"))).otherwise(C(pos) - 1)
    ranked = b.select(*keys, "object_id", (slot + 1).cast("long").alias("new_pos"), F.lit(False).alias("exploratory"))
    e = exploratory.join(nb, list(keys)).where(C("__nb") > start)
    j = C(pos) - 1
    spot = start + j + F.least(run * (j + 1), C("__nb") - start)
    return ranked.unionByName(e.select(*keys, "object_id", (spot + 1).cast("long").alias("new_pos"), F.lit(True).alias("exploratory")))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "position") -> DataFrame:
    return numbered(df, keys, order, out)


def train_split(df: DataFrame, key: Column, seed: str, share: float = 0.8) -> DataFrame:
    """Shuffled split by md5 order: the first ⌊share·n⌋ rows train, at least one. Numbered by range, not in one task."""
    n = df.count()
    cut_at = max(1, math.floor(n * share))
    h = df.withColumn("__h", F.md5(F.concat(F.lit(seed + "|"), key).cast("binary"))).withColumn("__k", key)
    return numbered(h, [], ["__h", "__k"], "__p").withColumn("split", F.when(C("__p") <= cut_at, "train").otherwise("test")).drop("__h", "__k", "__p")
