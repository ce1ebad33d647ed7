"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of one to three letters, with a space for whatever stands between words; tf is 1 + log(count), idf comes from
all labelled documents, vectors have length one. Weights are fitted by follow-the-regularised-leader with elastic-net penalties on a
sample of at most `sample` labelled documents, the same number of each language, those whose ids and texts have the least hashes; a fifth is
kept back to calibrate the temperature. Sample and weights have a fixed size; counts and predictions cover every document, whole.

Null texts and texts without a letter are `und` with score 0, and so is everything if there is nothing to learn from. Rows without lang
aren't learnt from. Ties go to the first language in alphabetical order. Every row is predicted by its text alone.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import in_runs, sliced, small_batches, stored, unused

FEATURES = 1 << 15
PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text, features ascending; empty if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    on = letters()[code]
    if not on.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run = np.where(on, code, 32).astype(np.uint32)
    run = np.r_[np.uint32(32), run[on | np.r_[True, on[:-1]]], np.uint32(32)]
    grams, key = [], np.zeros(len(run), np.uint32)
    for n in range(3):
        key = (key[: len(run) - n] ^ run[n:]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        grams.append((key * np.uint32(2 * n + 0x85EBCA6B)) >> np.uint32(17))
    total = np.bincount(np.concatenate(grams), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """Languages, idf, weights (features x languages) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counted(text)
        if not len(at) or not self.langs:
            return "und", 0.0
        p = softmax(self.vector(at, n) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of those each feature is in."""

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                total[counted(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, total[at]])], ["feature", "n"])

    df = np.zeros(FEATURES + 1, np.int64)
    with small_batches(texts.sparkSession):
        for r in texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # a row per feature
            df[r.feature] = r.n
    return int(df[-1]), df[:-1]


def sample_vectors(rows: DataFrame, model: Model) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Vectors and labels of the sampled (lang, text), in a fixed order."""
    number = {lang: i for i, lang in enumerate(model.langs)}

    def vectors(batches):
        for batch in sliced(batches):
            out = [(h, number[lang], at, model.vector(at, n)) for h, lang, text in zip(*(c.to_pylist() for c in batch.columns)) for at, n in [counted(text)] if len(at)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "y", "at", "x"])

    one = rows.select("h", "lang", "text").mapInArrow(vectors, "h long, y int, at array<int>, x array<float>").groupBy("h", "y").agg(F.first("at").alias("at"), F.first("x").alias("x"))
    with small_batches(rows.sparkSession):
        got = one.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])  # `sample` rows at most
    at, x = got["at"].combine_chunks(), got["x"].combine_chunks()
    return [(a.values.to_numpy(), b.values.to_numpy().astype(np.float64)) for a, b in zip(at, x)], got["y"].to_numpy()


def ftrl(vectors, labels: np.ndarray, n_langs: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((FEATURES, n_langs)), np.zeros((FEATURES, n_langs))
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            at, x = vectors[i]
            w, had = weights(z[at], n[at]), n[at]
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(had + g * g) - np.sqrt(had)) / alpha * w
            n[at] = had + g * g
    return weights(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log-loss, by golden section on its logarithm. As in Platt scaling the targets keep one part in n + 2 for
    the other languages, so that separable samples don't make it vanish."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    rest = 1 / (len(labels) + 2)
    target = np.full(logits.shape, rest / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - rest
    loss = lambda t: -(target * np.log(softmax(logits / np.exp(t)) + 1e-300)).sum(1).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def trained(labelled: DataFrame, sample: int = 4000, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """A model learnt from (doc_id, lang, text)."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, df = document_frequency(known.select("text"))
    model = Model(sorted(per_lang), np.log((1 + total) / (1 + df)) + 1, np.zeros((FEATURES, len(per_lang))))
    if not per_lang:
        return model
    each = max(1, sample // len(per_lang))
    share = F.create_map(*[F.lit(v) for lang, n in per_lang.items() for v in (lang, 1.5 * each / n)])
    hashed = known.select(F.xxhash64("doc_id", "text", F.lit(7)).alias("h"), "lang", "text")
    small = hashed.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = small.select("h", "lang").distinct().withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= each).select("h", "lang")
    picked = small.join(F.broadcast(stored(chosen, "language-sample")), ["h", "lang"], "left_semi")  # `sample` rows at most
    vectors, labels = sample_vectors(picked, model)
    back = np.arange(len(vectors)) % 5 == 4
    fit = np.flatnonzero(~back)
    model.weights = ftrl([vectors[i] for i in fit], labels[fit], len(per_lang), epochs, alpha, beta, l1, l2)
    if back.any():
        model.temperature = calibrated(np.array([vectors[i][1] @ model.weights[vectors[i][0]] for i in np.flatnonzero(back)]), labels[back])
    return model


def predicted(docs: DataFrame, model: Model, out: str = "__lang") -> DataFrame:
    """`docs` with a struct `out` (lang, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # features x languages numbers

    @F.arrow_udf(PREDICTED)
    @in_runs
    def lang(texts: pa.Array) -> pa.Array:
        got = [held.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return docs.withColumn(out, lang("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of documents that is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang), learnt from those that aren't held out."""
    model = trained(docs.where(~held_out()).select("doc_id", "lang", "text"), **how)
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))


def accepted(docs: DataFrame, min_score: float = 0.5, **how) -> DataFrame:
    """The rows of `docs` whose language is known with a score of at least `min_score`."""
    model = trained(docs.where(~held_out()).select("doc_id", "lang", "text"), **how)
    found = unused(docs, "lang")
    return predicted(docs, model, found).where((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= min_score)).drop(found)
