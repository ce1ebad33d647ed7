"""Triplets, the projection trainer, promotion and evaluation sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste.functions import vec
from modiste.operators.aggregates import triplet_accuracy
from modiste.operators.sets import label_complement
from modiste.scale import first_k

C = F.col


def _lot(seed: str, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))


def triplets(items: DataFrame, seed: str, cap: int = 40, run: str = "run_id") -> DataFrame:
    """(run, i, anchor, positive, negative) from (run, object_id, kept): min(2·kept, 4·rejected, 40) draws per run, for runs with
    two kept and one rejected item.

    The draw is by md5 order: the i-th triplet takes anchor, positive and negative at fixed offsets in three shuffled lists. As a
    run draws at most `cap` triplets, only the first `cap`+1 of each list are ranked, however long the run is.
    """
    kept = items.where("kept").select(run, "object_id")
    rejected = items.where("NOT kept").select(run, "object_id")
    sizes = items.groupBy(run).agg(F.count_if("kept").alias("k"), F.count_if(~C("kept")).alias("r")).where("k >= 2 AND r >= 1")
    sizes = sizes.withColumn("n", F.least(2 * C("k"), 4 * C("r"), F.lit(cap))).withColumn("ku", F.least("k", F.lit(cap + 1))).withColumn("ru", F.least("r", F.lit(cap + 1)))
    a = first_k(kept, [run], [_lot(seed + "a", C("object_id")), "object_id"], cap + 1, "s")
    n = first_k(rejected, [run], [_lot(seed + "n", C("object_id")), "object_id"], cap + 1, "s")
    draws = sizes.select(run, "ku", "ru", F.explode(F.sequence(F.lit(0), (C("n") - 1).cast("int"))).alias("i"))
    draws = draws.withColumn("sa", C("i") % C("ku") + 1).withColumn("sp", (C("i") + 1 + F.floor(C("i") / C("ku")) % (C("ku") - 1)) % C("ku") + 1).withColumn("sn", C("i") % C("ru") + 1)
    out = draws.join(a.select(run, C("s").alias("sa"), C("object_id").alias("anchor")), [run, "sa"])
    out = out.join(a.select(run, C("s").alias("sp"), C("object_id").alias("positive")), [run, "sp"]).join(n.select(run, C("s").alias("sn"), C("object_id").alias("negative")), [run, "sn"])
    return out.select(run, C("i").cast("long").alias("i"), "anchor", "positive", "negative")


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select("object_id", vec.normalize(C("vec")).alias("vec"))
    for side in ("anchor", "positive", "negative"):
        rows = rows.join(v.select(C("object_id").alias(side), C("vec").alias(f"{side}_vec")), side)
    return rows


#: bytes of a tile of a packed gradient, and tasks that add up those of all others
TILE_BYTES, GROUPS = 1 << 20, 16
PACKED = "part int, tile int, loss double, active long, packed binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile of a task, in the order they come."""
    total: dict[int, list] = {}
    for batch in batches:
        for part, tile, loss, active, data in zip(*batch.columns):
            tile, value = tile.as_py(), np.frombuffer(data.as_buffer())
            if tile in total:
                had = total[tile]
                total[tile] = [had[0], had[1] + loss.as_py(), had[2] + active.as_py(), had[3] + value]
            else:
                total[tile] = [part.as_py(), loss.as_py(), active.as_py(), value.copy()]
    for tile, (part, loss, active, value) in sorted(total.items()):
        yield _packed(part, tile, loss, active, value)


def _packed(part: int, tile: int, loss: float, active: int, value: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([tile], pa.int32()), pa.array([loss], pa.float64()), pa.array([active], pa.int64()), pa.array([value.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "tile", "loss", "active", "packed"])


def gradient(data: DataFrame, w: np.ndarray, margin: float) -> tuple[np.ndarray, float, int]:
    """Sum of the gradients of the triplets within the margin, their hinge losses and their number.

    A task packs its matrix into tiles of whole rows, one row of bytes each; tiles are added by a tree, GROUPS tasks a tile and then one, in
    the order of tasks, so the driver gets one matrix."""
    dim = len(w)
    held = data.sparkSession.sparkContext.broadcast(w)
    rows_a_tile = max(1, TILE_BYTES // (8 * dim))

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss, active = np.zeros((dim, dim)), 0.0, 0
        m = held.value
        for b in batches:
            a, p, n = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in b.columns)
            pn = p - n
            wa, wpn = a @ m.T, pn @ m.T
            hinge = margin - np.einsum("ij,ij->i", wa, wpn)
            on = hinge > 0
            if on.any():
                g += wa[on].T @ pn[on] + wpn[on].T @ a[on]
                loss, active = loss + float(hinge[on].sum()), active + int(on.sum())
        if active:
            part = TaskContext.get().partitionId()
            for tile, at in enumerate(range(0, dim, rows_a_tile)):
                yield _packed(part, tile, loss if not at else 0.0, active if not at else 0, g[at : at + rows_a_tile])

    doubles = [C(c).cast("array<double>").alias(c) for c in ("anchor_vec", "positive_vec", "negative_vec")]
    parts = data.select(*doubles).mapInArrow(gradients, PACKED)
    tiles = -(-dim // rows_a_tile)
    grouped = parts.repartition(GROUPS * tiles, "tile", C("part") % GROUPS).sortWithinPartitions("tile", "part").mapInArrow(_added, PACKED)
    whole = grouped.repartition(tiles, "tile").sortWithinPartitions("tile", "part").mapInArrow(_added, PACKED).collect()
    held.unpersist()
    g = np.zeros((dim, dim))
    for r in whole:
        value = np.frombuffer(r.packed).reshape(-1, dim)
        g[r.tile * rows_a_tile : r.tile * rows_a_tile + len(value)] = value
    return g, sum(r.loss for r in whole), sum(r.active for r in whole)


def train_projection(rows: DataFrame, dim: int, epochs: int = 15, lr: float = 0.5, margin: float = 0.2, batch_rows: int = 4096) -> tuple[np.ndarray, list[float]]:
    """Bilinear hinge training of W (dim × dim), starting at the identity. `rows` carry anchor/positive/negative vectors.

    Every step is one Spark job over a hashed slice of the triplets: `lr` times the mean gradient of the slice's triplets within the
    margin, at the slice's starting W (mini-batch instead of per-sample descent); slices have about `batch_rows` triplets.
    """
    steps_per_epoch = max(1, -(-rows.count() // batch_rows))
    data = rows.select("anchor_vec", "positive_vec", "negative_vec", F.pmod(F.xxhash64("anchor", "positive", "negative"), F.lit(steps_per_epoch)).alias("slice")).persist()
    w, losses = np.eye(dim), []
    try:
        for _ in range(epochs):
            loss_sum, active_sum = 0.0, 0
            for step in range(steps_per_epoch):
                g, loss, active = gradient(data.where(C("slice") == step), w, margin)
                if active:
                    w = w + lr / active * g
                loss_sum, active_sum = loss_sum + loss, active_sum + active
            losses.append(loss_sum / active_sum if active_sum else 0.0)
    finally:
        data.unpersist()
    return w, losses


def promote(previous: DataFrame, candidate: DataFrame, gain: float = 0.01) -> DataFrame:
    """One row: both accuracies and whether the candidate beats the previous one by `gain`. Inputs are one-row accuracy tables."""
    p = previous.select(F.lit("previous").alias("which"), "accuracy")
    both = p.unionByName(candidate.select(F.lit("candidate").alias("which"), "accuracy"))
    row = both.agg(F.max(F.when(C("which") == "previous", C("accuracy"))).alias("previous"), F.max(F.when(C("which") == "candidate", C("accuracy"))).alias("candidate"))
    return row.withColumn("promoted", C("candidate") >= F.coalesce("previous", F.lit(0.0)) + gain)


def accuracy(test: DataFrame, vectors: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    return triplet_accuracy(test, vectors, None if weights is None else weights.tolist())


def evaluation_sets(items: DataFrame, labels: Sequence[str], minimum: int = 20) -> DataFrame:
    """Kept/rejected rows of every label that has enough kept items."""
    rows = label_complement(items, labels)
    enough = rows.groupBy("label").agg(F.count_if("kept").alias("n")).where(C("n") >= minimum).select("label")
    return rows.join(enough, "label", "left_semi")
