"""Whitening of embeddings by shifted CholeskyQR.

Entries c become the integers x = floor(64 c) + 1000000. Y holds the centred rows x - S/n, with n rows and sums S. A pass over the table takes the Gram
matrix G of Y inv(R), where R is what is known so far; a Cholesky factor of G, shifted by a little of its size where G isn't safely positive, is
put before R, until the rows are orthonormal. Rows meet R by triangular solves only, so their covariance, with its squared condition, is never what
components are taken from: those come from the singular values of R, a matrix of dimensions x dimensions.

Every pass gives one packed matrix a task; tasks' matrices are added in two steps, by GROUPS tasks and then on the driver, in the order of their
tasks. What is broadcast is one matrix of dimensions x dimensions.

Rows with a null vector, or with entries that are null, not finite or whose x isn't a 64-bit integer, are dropped. Entries that a shorter vector lacks
count as zero. Repeated rows, with one id or without, are rows of their own. Directions without variance (singular value below RANK of the
largest) have no component, so a table of equal rows, of one row or of none has no result. Of both signs of a component the one is taken that makes
its largest entry positive. Deviations beyond 64 bits are null. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modiste.llm.common import stored

SCALE, OFFSET = 64, 1_000_000
#: entries held by a block of rows
BLOCK = 1 << 18
#: singular values below this part of the largest one are none
RANK = 1e-11
#: passes of CholeskyQR at most; three do unless the shift was needed more than once
PASSES = 8
#: tasks that add up the matrices of all others
GROUPS = 16
PACKED = "part int, n long, packed binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the integer vectors of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    far = F.lit(float(1 << 62))
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < far))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("x"))


def blocks(batches, width: int):
    """(vec_ids, matrix of int64) for runs of rows."""
    for batch in batches:
        xs = batch.column(1)
        step = max(1, BLOCK // max(width, 1))
        for at in range(0, batch.num_rows, step):
            part = xs.slice(at, step)
            ends = part.offsets.to_numpy()
            flat = part.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            n = np.diff(ends)
            if (n == width).all():
                m = flat.reshape(len(n), width)
            else:
                m = np.full((len(n), width), OFFSET, np.int64)
                m[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)] = flat
            yield batch.column(0).slice(at, step), m


def exact_sums(m: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    low, high = (m & 0x7FFFFFFF).sum(0), (m >> 31).sum(0)
    return [(int(h) << 31) + int(l) for h, l in zip(high, low)]


@dataclass
class Fit:
    """What the rows have in common: width, number and sums of the integers."""

    width: int
    n: int
    sums: list[int] = field(default_factory=list)

    def centred(self, m: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: with S = q n + r, it is (x - q) - r/n."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (m - whole).astype(np.float64) - rest

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """The sums over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        near = ((self.centred(m) * self.n) ** 2).sum(1)
        out: list[int | None] = [None] * len(m)
        small = np.flatnonzero(near < 2.0**62)
        if len(small):
            # all terms fit into 64 bits; n x and S need not, but wrap alike
            sums = np.array([s & 0xFFFFFFFFFFFFFFFF for s in self.sums], np.uint64)
            d = (m[small].view(np.uint64) * np.uint64(self.n) - sums).view(np.int64)
            for i, x in zip(small.tolist(), (d * d).sum(1).tolist()):
                out[i] = x
        for i in np.flatnonzero(near >= 2.0**62).tolist():
            x = sum((self.n * int(a) - s) ** 2 for a, s in zip(m[i], self.sums))
            out[i] = x if x < 1 << 63 else None
        return out


def packed(part: int, n: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([value.tobytes()], pa.binary())], ["part", "n", "packed"])


def summed(parts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and packed matrices of all tasks, added in the order of tasks: by GROUPS tasks first, then on the driver."""

    def add(batches):
        first, n, total = None, 0, None
        for batch in batches:
            for part, k, data in zip(*batch.columns):
                value = np.frombuffer(data.as_buffer())
                first, n, total = part.as_py() if total is None else first, n + k.as_py(), value.copy() if total is None else total + value
        if total is not None:
            yield packed(first, n, total)

    grouped = parts.repartition(GROUPS, F.col("part") % GROUPS).sortWithinPartitions("part").mapInArrow(add, PACKED)
    rows = sorted(grouped.collect(), key=lambda r: r.part)  # GROUPS at most
    return sum(r.n for r in rows), sum((np.frombuffer(r.packed) for r in rows), np.zeros(1))


def sized(rows: DataFrame) -> Fit:
    """Width, number and exact sums of the rows."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return Fit(0, 0)

    def count(batches):
        n, total = 0, [0] * width
        for _, m in blocks(batches, width):
            n += len(m)
            total = [a + b for a, b in zip(total, exact_sums(m))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    # decimals hold what 64 bits may not
    parts = rows.mapInArrow(count, "n long, sums array<string>")
    total = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row per dimension
    return Fit(width, total[0].n, [int(r.s) for r in total]) if total else Fit(0, 0)


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows times the inverse of an upper triangular matrix, column after column."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(rows: DataFrame, fit: Fit, factors: list[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the centred rows after solves with all factors."""
    held = rows.sparkSession.sparkContext.broadcast((fit, factors))  # a few matrices of dimensions x dimensions

    def multiply(batches):
        fit, factors = held.value
        total, n = np.zeros((fit.width, fit.width)), 0
        for _, m in blocks(batches, fit.width):
            y = fit.centred(m)
            for r in factors:
                y = solved(y, r)
            total += y.T @ y
            n += len(m)
        if n:
            yield packed(TaskContext.get().partitionId(), n, total)

    return summed(rows.mapInArrow(multiply, PACKED))[1].reshape(fit.width, fit.width)


def factor(g: np.ndarray) -> np.ndarray:
    """An upper triangular R with R'R = G + s, s as small as Cholesky allows, none where it can be."""
    size = max(float(np.abs(np.diag(g)).max()), np.finfo(float).tiny)
    shift = 0.0
    while True:
        try:
            low = np.linalg.cholesky(g + shift * np.eye(len(g)))
            if np.diag(low).min() ** 2 > 1e-14 * size or shift:
                return low.T
        except np.linalg.LinAlgError:
            pass
        shift = max(shift * 10, 11 * np.finfo(float).eps * len(g) * size)


@dataclass
class Whitening:
    """Fit list, components in columns, their standard deviations and shares of the trace."""

    fit: Fit
    axes: np.ndarray
    spread: np.ndarray
    explained: np.ndarray

    def apply(self, m: np.ndarray) -> np.ndarray:
        return (self.fit.centred(m) @ self.axes) / self.spread


def fitted(rows: DataFrame, components: int = 32) -> Whitening:
    """Orthogonalise by passes of shifted CholeskyQR, then take the singular values of the composed factor."""
    fit = sized(rows)
    factors: list[np.ndarray] = []
    composed, trace = np.eye(fit.width), 0.0
    for turn in range(PASSES if fit.n > 1 else 0):
        g = gram(rows, fit, factors)
        if turn == 0:
            trace = float(np.trace(g)) / fit.n
            if not trace:
                break
        if turn and float(np.abs(g - np.eye(len(g))).max()) < 1e-13 * fit.width:
            break
        r = factor(g)
        factors.append(r)
        composed = r @ composed
    if not trace:
        return Whitening(fit, np.zeros((fit.width, 0)), np.zeros(0), np.zeros(0))
    _, s, vt = np.linalg.svd(composed)
    keep = np.flatnonzero(s > RANK * s[0])[:components]
    axes = vt[keep].T
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return Whitening(fit, axes, s[keep] / math.sqrt(fit.n), (s[keep] ** 2 / fit.n) / trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity. Tasks centre their blocks before they multiply and pass on
    their means, by which blocks are joined."""
    width = len(model.spread)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def cover(batches):
        n, mean, square = 0, np.zeros(width), np.zeros((width, width))
        for _, m in blocks(batches, held.value.fit.width):
            y = held.value.apply(m)
            own = y.mean(0)
            y = y - own
            step, both = own - mean, n + len(m)
            square += y.T @ y + np.outer(step, step) * (n * len(m) / both)
            mean, n = mean + step * (len(m) / both), both
        if n:
            # what adds up over tasks: n mean, and the square about zero of small means
            yield packed(TaskContext.get().partitionId(), n, np.concatenate([n * mean, (square + n * np.outer(mean, mean)).ravel()]))

    n, total = summed(rows.mapInArrow(cover, PACKED))
    mean = total[:width] / n
    cov = total[width:].reshape(width, width) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(width)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "integer-vectors")
    model = fitted(rows, components)
    width = len(model.spread)
    if not width:
        return spark.createDataFrame([], OUT)
    error = identity_error(rows, model)
    held = spark.sparkContext.broadcast(model)

    def project(batches):
        model = held.value
        for ids, m in blocks(batches, model.fit.width):
            y, k = model.apply(m), len(m)
            nr = np.repeat(np.arange(k), width)
            columns = [ids.take(pa.array(nr)), np.tile(np.arange(1, width + 1, dtype=np.int32), k), np.full(k * width, model.fit.n), pa.array(model.fit.deviations(m), pa.int64()).take(pa.array(nr)),
                       y.ravel(), np.tile(model.explained, k), np.full(k * width, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, OUT)
