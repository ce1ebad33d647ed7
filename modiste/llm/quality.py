"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: runs of one to three characters (case kept, white space as one space), words and pairs of words, and runs of words
equal to the word before, all hashed into FEATURES places. An indicator is scaled by the logarithm of the ratio of its shares in both classes, counted
over all labelled documents. A linear model with hinge loss is fitted to the scaled indicators, vectors of length one, by dual coordinate descent, and
its weights are mixed with their mean size, which is naive Bayes. Platt's sigmoid turns margins into chances.

The fit takes at most `sample` labelled documents, the same number of either class, those whose ids have the least hashes; a fifth of them is kept
back for the sigmoid, weighted by the true numbers of the classes. Sample, weights and what is broadcast have a fixed size; counts and scores cover every
document, whole.

A document is learnt from if the labels of its id say 0 or 1 and don't differ; rows that repeat an id count in the statistics, and one of them in the
sample. Null and empty texts have no n-grams and get the chance at margin zero plus bias. Without documents of both classes every score is the share of
label 1, one half if there is no label. Score 0.5 is label 1. Scores depend on the text alone. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import in_runs, sliced, stored
from modiste.scale import bitmap_of, with_suspicion

BITS = 18
FEATURES = 1 << BITS
#: characters whose n-grams are hashed at once
RUN = 1 << 20
#: longest run of equal words told apart
EQUAL = 4
_random = np.random.default_rng(2012)
ODD = _random.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
SPACES = np.array([0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[salt]
    return x ^ (x >> np.uint64(29))


def grams(text: str | None) -> np.ndarray:
    """The features of a text, ascending."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(FEATURES, bool)

    def mark(hashes: np.ndarray) -> None:
        seen[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    blank = np.isin(code, SPACES)
    if blank.all():
        return np.empty(0, np.int64)
    # one blank between words, none around them
    keep = ~blank | np.r_[False, ~blank[:-1]]
    keep[np.flatnonzero(~blank)[-1] + 1 :] = False
    code, blank = np.where(blank, np.uint32(32), code)[keep], blank[keep]
    for at in range(0, len(code), RUN):
        part = code[at : at + RUN + 2].astype(np.uint64)
        key = np.zeros(len(part), np.uint64)
        for n in range(3):
            key = mixed(key[: len(part) - n] * np.uint64(0x9E3779B97F4A7C15) + part[n:], n)
            mark(mixed(key[:RUN], 3 + n))
            if len(key) < 2:
                break
    # words: the sum of hashes of (character, place)
    inside = np.flatnonzero(~blank)
    first = np.r_[True, np.diff(inside) > 1]
    starts = np.flatnonzero(first)
    place = np.arange(len(inside)) - np.repeat(starts, np.diff(np.r_[starts, len(inside)]))
    words = np.add.reduceat(mixed(code[inside].astype(np.uint64) * ODD[6] + place.astype(np.uint64) * ODD[7], 8), starts)
    mark(mixed(words, 9))
    mark(mixed(words[:-1] * ODD[10] + words[1:], 11))
    same = words[1:] == words[:-1]
    for n in range(EQUAL):
        if not same.any():
            break
        seen[int(ODD[12 + n] >> np.uint64(64 - BITS))] = True
        same = same[1:] & same[:-1]
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Scales of the indicators, weights of the scaled ones, bias and the sigmoid."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def vector(self, at: np.ndarray) -> np.ndarray:
        x = self.ratio[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def margin(self, at: np.ndarray) -> float:
        return float(self.vector(at) @ self.weights[at]) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams(text)) + self.offset, -700, 700))))


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of documents that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lessons(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the ids to learn from, each once."""
    said = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("most"))
    return stored(said.where("label = most").select("doc_id", "label"), "lessons")


def labelled(docs: DataFrame, said: DataFrame, buckets: int = 1024) -> DataFrame:
    """(label, text) of the documents to learn from. A bitmap of the ids, of a fixed size, keeps other documents out of the join's shuffle."""
    ids = [F.col("doc_id").cast("long")]
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = with_suspicion(known, ids, stored(bitmap_of(ids, said, buckets), "lesson-bits"), buckets, "suspect").where("suspect").drop("suspect")
    return met.join(said, "doc_id").select("label", "text")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of either class, and of those each feature is in."""

    def count(batches):
        total, n = np.zeros((2, FEATURES), np.int64), [0, 0]
        for batch in sliced(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[label, grams(text)] += 1
                n[label] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), *(pa.array(np.r_[n[y], total[y, at]]) for y in (0, 1))], ["feature", "n0", "n1"])

    found = rows.select("label", "text").mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # a row per feature
    counts = np.zeros((2, FEATURES + 1), np.int64)
    at = found["feature"].to_numpy()
    for y in (0, 1):
        counts[y, at] = found[f"n{y}"].to_numpy()
    return counts[:, -1], counts[:, :-1]


def ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature among those of label 1 to that of label 0; zero for features never seen."""
    p = counts + alpha
    r = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    return np.where(counts.any(0), r, 0.0)


def sampled(said: DataFrame, totals: np.ndarray, sample: int) -> DataFrame:
    """(doc_id, label): of either class the half of `sample` with the least hashes; `totals` are the ids of the classes."""
    half = sample // 2
    share = [F.lit(min(1.0, 1.5 * half / max(int(n), 1))) for n in totals]
    h = F.xxhash64("doc_id", F.lit(13))
    small = F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    order = Window.partitionBy("label").orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id")
    return stored(said.where(small).withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= half).select("doc_id", "label"), "sample")


def sample_vectors(docs: DataFrame, chosen: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the chosen ids, in their order; of rows that share an id one counts."""

    def features(batches):
        for batch in sliced(batches):
            out = [(i, y, h, grams(t).astype(np.int32)) for i, y, h, t in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())])], ["doc_id", "label", "h", "at"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))  # `sample` ids at most
    one = rows.mapInArrow(features, "doc_id long, label int, h long, at array<int>").groupBy("doc_id", "label").agg(F.min_by("at", "h").alias("at"))
    got = one.toArrow().sort_by([("doc_id", "ascending")])
    return [x.values.to_numpy() for x in got["at"].combine_chunks()], got["label"].to_numpy()


def hinge(vectors: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 1.0, epochs: int = 40, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of the least 1/2 |w|^2 + cost * sum of hinge losses, by dual coordinate descent; the bias is the weight of a constant 1."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(vectors))
    square = np.array([float(x @ x) + 1 for _, x in vectors])
    for epoch in range(epochs):
        most = 0.0
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            at, x = vectors[i]
            slope = signs[i] * (float(w[at] @ x) + bias) - 1
            if (alpha[i] == 0 and slope >= 0) or (alpha[i] == cost and slope <= 0):
                continue
            most = max(most, abs(slope))
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * signs[i]
            w[at] += step * x
            bias += step
            alpha[i] = new
        if most < tolerance:
            break
    return w, bias


def sigmoid(margins: np.ndarray, labels: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid by Newton's method, classes weighted by their true numbers."""
    have = np.array([(labels == y).sum() for y in (0, 1)])
    if not have.all():
        return 0.0, float(np.log((totals[1] + 1) / (totals[0] + 1)))
    target = np.where(labels == 1, (have[1] + 1) / (have[1] + 2), 1 / (have[0] + 2))
    weight = (totals / totals.sum() * have.sum() / have)[labels]
    x = np.c_[margins, np.ones(len(margins))]
    b = np.array([0.0, np.log((totals[1] + 1) / (totals[0] + 1))])

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * float(b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
        down = x.T @ (weight * (target - p)) - 2e-6 * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2), down)
        t = 1.0
        while t > 1e-8 and loss(b + t * step) > loss(b):
            t /= 2
        b = b + t * step
        if float(np.abs(t * step).max()) < 1e-8:
            break
    return float(b[0]), float(b[1])


def trained(docs: DataFrame, labels: DataFrame, sample: int = 8000, beta: float = 0.75, cost: float = 1.0) -> Model:
    """A model learnt from documents (doc_id, text) and labels (doc_id, quality); `beta` is the part of the fitted weights beside their mean size."""
    said = lessons(labels)
    totals, counts = class_counts(labelled(docs, said))
    model = Model(ratios(counts), np.zeros(FEATURES))
    if not totals.all():
        model.offset = float(np.log((totals[1] + 1) / (totals[0] + 1))) if totals.any() else 0.0
        return model
    ids = {r.label: r.n for r in said.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, y = sample_vectors(docs.select("doc_id", "text"), sampled(said, np.array([ids[0], ids[1]]), sample))
    back = np.random.default_rng(5).permutation(len(found)) % 5 == 4
    fit = np.flatnonzero(~back)
    w, model.bias = hinge([(found[i], model.vector(found[i])) for i in fit], 2.0 * y[fit] - 1, cost)
    used = w != 0
    model.weights = beta * w + (1 - beta) * (np.abs(w[used]).mean() if used.any() else 0.0) * (model.ratio != 0)
    test = np.flatnonzero(back) if back.any() else fit
    model.slope, model.offset = sigmoid(np.array([model.margin(found[i]) for i in test]), y[test], totals)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `__quality`."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per feature

    @F.arrow_udf(T.DoubleType())
    @in_runs
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn("__quality", score("text"))


def judged(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text)."""
    model = trained(docs, labels, **how)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= 0.5).cast("int").alias("predicted"))
