"""Vector column functions on `array<double>`; JVM-side higher-order functions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from modiste.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either norm is 0."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


@F.arrow_udf(BinaryType())
def packed(vectors: pa.Array) -> pa.Array:
    """The components of each vector as bytes, which move and reach Python at once: a byte with their size, four where single precision holds them all exactly,
    and the components. Null for vectors that are null or hold null, with which every cosine is null."""
    ends, flat = vectors.offsets.to_numpy(), vectors.values
    double = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    with np.errstate(over="ignore"):
        single = double.astype(np.float32)
    wide = np.r_[0, np.cumsum((single != double) & ~np.isnan(double))]
    holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    out = []
    for at, end, known in zip(ends[:-1].tolist(), ends[1:].tolist(), vectors.is_valid().to_pylist()):
        if not known or holes[at] != holes[end]:
            out.append(None)
        else:
            out.append(b"\x08" + double[at:end].tobytes() if wide[at] != wide[end] else b"\x04" + single[at:end].tobytes())
    return pa.array(out, pa.binary())


#: rows whose cosines are taken at once
COSINE_ROWS = 1024


def cosine_rows(a: pa.BinaryArray, b: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, known): `cosine` row by row for packed vectors. Sums are taken in the order of the components, as by `cosine`, so both give the same bits."""
    sides, code, known = [], np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for x in (a, b):
        data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
        known &= x.is_valid().to_numpy(zero_copy_only=False)
        item = np.zeros(len(x), np.int64)
        item[known] = data[ends[:-1][known]]
        sides.append((data, ends[:-1], np.diff(ends)))
        code = (code << 32) + (np.diff(ends) << 4) + item
    out = np.zeros(len(a))

    def components(side: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        data, starts, sizes = side
        first, size = starts[rows[0]], sizes[rows[0]]
        if (starts[rows] == first + size * np.arange(len(rows))).all():
            m = data[first : first + size * len(rows)].reshape(len(rows), size)
        else:
            m = data[starts[rows, None] + np.arange(size)]
        kind = np.float32 if data[first] == 4 else np.float64
        return np.ascontiguousarray(m[:, 1:]).view(kind).astype(np.float64).T.copy()

    def norms(m: np.ndarray) -> np.ndarray:
        total = np.zeros(m.shape[1])
        for component in m:
            total += component * component
        return np.sqrt(total)

    for some in np.unique(code[known]):
        alike = np.flatnonzero(known & (code == some))
        for at in range(0, len(alike), COSINE_ROWS):
            rows = alike[at : at + COSINE_ROWS]
            x, y = (components(side, rows) for side in sides)
            length, total = norms(x) * norms(y), np.zeros(len(rows))
            for one, other in zip(x, y):
                total += one * other
            with np.errstate(invalid="ignore", divide="ignore"):
                out[rows] = np.where(length == 0, 0.0, total / length)
            known[rows] = (length == 0) | (len(x) == len(y))
    return out, known


def half_up(values: np.ndarray, places: int) -> np.ndarray:
    """Rounded as Spark rounds: halves of what is printed away from zero."""
    out, many = np.round(values, places), values * 10.0**places
    for i in np.flatnonzero(np.abs(many - np.floor(many) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


def scale(a: Column, f: Column) -> Column:
    return F.transform(a, lambda x: x * f)


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector is returned as is."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def combine(a: Column, wa: float | Column, b: Column, wb: float | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def blend(a: Column, b_mean: Column, w: float | Column) -> Column:
    """normalize((1-w)·a + w·unit(b)); a missing side leaves the other unchanged."""
    w = F.lit(w) if not isinstance(w, Column) else w
    return F.when(b_mean.isNull(), a).when(a.isNull(), b_mean).otherwise(normalize(combine(a, 1 - w, normalize(b_mean), w)))


def subtract(a: Column, neg_mean: Column, w: float = 0.25, unit_mean: bool = True) -> Column:
    """normalize(a − w·neg); with `unit_mean` the negative mean is made unit length first."""
    neg = normalize(neg_mean) if unit_mean else neg_mean
    return F.when(neg_mean.isNull(), a).otherwise(normalize(combine(a, 1.0, neg, -w)))


def mean_by(df: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = None, unit: bool = True, out: str = "vec",
            **extra: Column) -> DataFrame:
    """Weighted mean of vectors per key. The summary is a partial aggregate, so a hot key costs one buffer per task."""
    v = array_to_vector(F.col(vec))
    mean = Summarizer.metrics("mean").summary(v, F.col(weight) if weight else F.lit(1.0))["mean"]
    agg = df.groupBy(*keys).agg(vector_to_array(mean).alias(out), *[c.alias(n) for n, c in extra.items()])
    return agg.withColumn(out, normalize(F.col(out))) if unit else agg


def projected(vectors: pa.ListArray, w: np.ndarray, unit: bool = True) -> pa.ListArray:
    """W·x of every list of the right length, straight from the flat buffer; others pass through."""
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    n = np.diff(ends)
    fits = (n == w.shape[1]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    own = np.repeat(fits, n)
    m = flat[own].reshape(-1, w.shape[1]) @ w.T
    if unit:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norm == 0, 1.0, norm)
    sizes = np.where(fits, w.shape[0], n)
    out = np.empty(sizes.sum())
    new = np.repeat(fits, sizes)
    out[new], out[~new] = m.ravel(), flat[~own]
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    kind = vectors.type.value_type
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out).cast(kind), mask=vectors.is_null() if vectors.null_count else None)


def project(vec: Column, rows: list[list[float]]):
    """unit(W·x) for a bounded W held by the driver, as an Arrow UDF; a vector of another size passes through."""
    w = np.asarray(rows, dtype=np.float64)

    @F.arrow_udf(ArrayType(DoubleType()))
    def apply(column: pa.Array) -> pa.Array:
        return projected(column, w)

    return apply(vec.cast("array<double>"))


def project_rows(df: DataFrame, rows: list[list[float]], vec: str = "vec", unit: bool = True) -> DataFrame:
    """W·x (unit length or raw) over a whole table in Arrow batches."""
    w = np.asarray(rows, dtype=np.float64)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(vec)
            yield pa.RecordBatch.from_arrays([projected(c, w, unit) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
