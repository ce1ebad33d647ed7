"""Vector operators over whole tables: clustering, ensembles, anchoring, health."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste.functions import vec
from modiste.scale import first_k

C = F.col


class Leaders:
    """The clusters of a sequential leader clustering, fed with blocks of vectors.

    A block is assigned at once against the clusters as they stand, and verified: under these assignments the similarities that each vector would have met
    at its turn, with the sums and norms that its predecessors leave, follow from matrix products. Up to the first vector that would have decided
    otherwise all is right, and so is its new decision, so the round is repeated with the new decisions until nothing changes. Blocks shrink where
    rounds settle little, down to single vectors, and grow again."""

    BLOCK, ROUNDS = 256, 6

    def __init__(self, threshold: float, width: int):
        self.threshold, self.sums, self.counts = threshold, np.zeros((0, width)), np.zeros(0, np.int64)
        self.first: np.ndarray | None = None
        self.block = self.BLOCK

    def add(self, rows: np.ndarray) -> None:
        if self.first is None and len(rows):
            self.first = rows[0].copy()
        while len(rows):
            part = rows[: self.block]
            settled = self.settle(part)
            rows = rows[settled:]
            self.block = min(self.BLOCK, 2 * self.block) if settled == len(part) else max(1, min(self.block, 2 * settled))

    def settle(self, rows: np.ndarray) -> int:
        """Take in the first rows whose decisions are verified; returns their number, at least one."""
        n, k = len(rows), len(self.counts)
        pairs = rows @ rows.T
        own = np.diag(pairs).copy()
        lower = np.tril(pairs, -1)
        before = np.c_[rows @ self.sums.T, np.zeros((n, n))]  # a column per cluster, and one for each row that may lead
        square = np.r_[(self.sums**2).sum(1), np.zeros(n)]
        size, turn = np.sqrt(own)[:, None], np.arange(n)
        choice, settled = None, 0
        for _ in range(self.ROUNDS):
            if choice is None:
                dots, norms, there = before, np.broadcast_to(square, before.shape), np.zeros((n, n), bool)
            else:
                member = np.zeros((n, k + n))
                member[turn, choice] = 1.0
                dots = before + lower @ member
                steps = member * (2 * dots + own[:, None])
                norms = square + np.cumsum(steps, 0) - steps
                there = (choice == k + turn)[None, :] & (turn[None, :] < turn[:, None])
            scale = np.sqrt(np.maximum(norms, 0.0)) * size
            like = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
            like[:, k:][~there] = -np.inf
            best = like.argmax(1)
            new = np.where(like[turn, best] > self.threshold, best, k + turn)
            if choice is not None:
                wrong = np.flatnonzero(new != choice)
                settled = int(wrong[0]) + 1 if len(wrong) else n
                if not len(wrong):
                    break
            choice = new
        if not settled:
            choice, settled = new, 1  # the first row has met the clusters as they stood
        taken, rows = choice[:settled], rows[:settled]
        leading = np.flatnonzero(taken == k + turn[:settled])
        number = np.full(k + n, -1)
        number[:k], number[k + leading] = np.arange(k), k + np.arange(len(leading))
        self.sums = np.r_[self.sums, np.zeros((len(leading), rows.shape[1]))]
        self.counts = np.r_[self.counts, np.zeros(len(leading), np.int64)]
        np.add.at(self.sums, number[taken], rows)
        np.add.at(self.counts, number[taken], 1)
        return settled

    def clusters(self) -> list[tuple[float, int, list[float]]]:
        """(weight, size, vector) by size, then age."""
        total = int(self.counts.sum())
        out = []
        for i in np.argsort(-self.counts, kind="stable"):
            norm = np.linalg.norm(self.sums[i])
            c = self.first if total == 1 else (self.sums[i] if norm == 0 else self.sums[i] / norm)
            out.append((float(self.counts[i] / total), int(self.counts[i]), c.tolist()))
        return out


def greedy_cluster(rows: DataFrame, key: str, order: Sequence[str], threshold: float = 0.78) -> DataFrame:
    """Sequential leader clustering per key: a vector joins the closest centroid above the threshold, else it leads a new one.

    The walk is order-dependent, so a key is read by one task in order, but as a stream of blocks: only the clusters' sums are held, never the
    group's rows. Output: (key, cluster, weight, size, vec), clusters by size then age. A lone vector is returned as it is.
    """
    kind = rows.schema[key].dataType.simpleString()
    ready = rows.where(C("vec").isNotNull()).select(key, C("vec").cast("array<double>").alias("vec"), *[o for o in order if o not in (key, "vec")]).repartition(C(key)).sortWithinPartitions(key, *order).select(key, "vec")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None

        def finished() -> pa.RecordBatch:
            found = held.clusters()
            n = len(found)
            columns = [pa.array([current] * n, key_type), pa.array(range(n), pa.int32()), *(pa.array([c[i] for c in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.list_(pa.float64()))))]
            return pa.RecordBatch.from_arrays(columns, [key, "cluster", "weight", "size", "vec"])

        for batch in batches:
            key_type = batch.column(0).type
            names, vecs = batch.column(0).to_pylist(), batch.column(1)
            flat, ends = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if held is None or names[at] != current:
                    if held is not None:
                        yield finished()
                    current, held = names[at], Leaders(threshold, int(ends[at + 1] - ends[at]))
                held.add(flat[ends[at] : ends[to]].reshape(to - at, -1))
                at = to
        if held is not None:
            yield finished()

    return ready.mapInArrow(walk, f"{key} {kind}, cluster int, weight double, size long, vec array<double>")


TIER_LIMITS = [3, 3, 1, 5, 1]


def ensemble_query(phrases: DataFrame, key: str = "query_id", limits: Sequence[int] = TIER_LIMITS) -> DataFrame:
    """Query vector from the first tier with a present phrase: unit mean of its first phrases, a lone one as it is.

    phrases: (key, tier, ord, vec or null). Tiers: signature + 2 alternatives, descriptor + 2, mood, up to 5 retrieval phrases, summary."""
    limit = F.array(*[F.lit(x) for x in limits])
    have = phrases.where(C("vec").isNotNull() & (C("ord") < F.get(limit, C("tier"))))
    first = have.groupBy(key).agg(F.min("tier").alias("tier"))
    rows = have.join(first, [key, "tier"], "left_semi")
    out = vec.mean_by(rows, [key], unit=False, n=F.count(F.lit(1)), tier=F.first("tier"))
    return out.withColumn("vec", F.when(C("n") == 1, C("vec")).otherwise(vec.normalize(C("vec"))))


def anchor_images(images: DataFrame, anchors: DataFrame, avoids: DataFrame | None, key: str = "query_id", weight: float = 0.10, negative: float = 0.125) -> DataFrame:
    """Blend every image vector with the mean of its query's anchors, then push it from the mean of the avoids. The means are
    one row per query, so the image side is joined, never paired."""
    a = vec.mean_by(anchors, [key], unit=False, out="__a")
    df = images.join(a, key, "left")
    out = vec.blend(C("vec"), C("__a"), weight)
    if avoids is not None:
        n = vec.mean_by(avoids, [key], unit=False, out="__n")
        df = df.join(n, key, "left")
        out = F.when(C("__a").isNull(), C("vec")).otherwise(vec.subtract(out, C("__n"), negative))
    return df.withColumn("vec", out).drop("__a", "__n")


def image_text_blend(images: DataFrame, texts: DataFrame, keys: Sequence[str] = ("object_id",), image_weight: float = 0.7) -> DataFrame:
    """unit(0.7·mean of image vectors + 0.3·text vector); one side alone is used as it is."""
    pooled = vec.mean_by(images, list(keys), out="__i")
    j = pooled.join(texts.select(*keys, C("vec").alias("__t")), list(keys), "full")
    mixed = vec.normalize(vec.combine(C("__i"), image_weight, C("__t"), 1 - image_weight))
    return j.select(*keys, F.when(C("__t").isNull(), C("__i")).when(C("__i").isNull(), C("__t")).otherwise(mixed).alias("vec"))


def weighted_combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """unit(Σ w·unit(v)/Σw) of rows (keys, vec, w); keys with differing sizes give null."""
    rows = parts.where(C("vec").isNotNull() & (F.size("vec") > 0) & (C("w") > 0)).withColumn("vec", vec.normalize(C("vec")))
    sizes = rows.groupBy(*keys).agg(F.min(F.size("vec")).alias("__lo"), F.max(F.size("vec")).alias("__hi"))
    ok = rows.join(sizes.where("__lo = __hi").select(*keys), list(keys), "left_semi")
    means = vec.mean_by(ok, list(keys), weight="w")
    return sizes.select(*keys).join(means, list(keys), "left")


def health(vectors: DataFrame, keys: Sequence[str] = (), norm_tolerance: float = 0.01) -> DataFrame:
    """Dimension, norm and missing-value report per key."""
    n = vec.norm(C("vec"))
    return vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).cast("long").alias("min_dim"), F.max(F.size("vec")).cast("long").alias("max_dim"),
                                      F.avg(n).alias("mean_norm"), F.count_if(F.abs(n - 1) > norm_tolerance).alias("bad_norm"), F.count_if(C("vec").isNull()).alias("missing"))


def too_similar(probes: DataFrame, key: str = "probe", limit: float = 0.97) -> DataFrame:
    """Pairs of probe vectors that are nearly the same, through the blocked scorer; each pair once."""
    from modiste.operators.topk import scored

    pairs = scored(probes.select(C(key).cast("string").alias("a"), "vec"), probes.select(C(key).cast("string").alias("object_id"), "vec"), None, limit, "a")
    return pairs.where("a < object_id").select("a", C("object_id").alias("b"), "score")
