"""The quality classifier: its parts against plain loops, held-out accuracy, odd tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modiste.llm import quality

FOLDER = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, label int, h string, quality string", "doc_id long, quality int, toxic int, text string"


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def plain_grams(text):
    """Names of the n-grams of a text."""
    spaces = set(map(chr, quality.SPACES.tolist()))
    words, word = [], ""
    for c in (text or "") + " ":
        if c not in spaces:
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return set()
    line = " ".join(words)
    out = {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)}
    out |= {("w", w) for w in words} | {("p", a, b) for a, b in zip(words, words[1:])}
    run = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        out |= {("same", n) for n in range(1, min(run, quality.EQUAL) + 1)}
    return out


def test_grams_follow_the_plain_rule(texts):
    """A feature for each plain n-gram: as many as distinct ones but for shared places, and equal sets for equal plain sets."""
    for _, t in texts[:60]:
        got, names = set(quality.grams(t).tolist()), plain_grams(t)
        assert len(got) <= len(names) and len(got) > 0.9 * len(names) - 3
    for text in ("ab", "\tab\n", " ab ", "ab  ab", "é", "😀 😀 😀"):
        assert len(quality.grams(text)) <= len(plain_grams(text)) <= len(quality.grams(text)) + 1
    assert quality.grams("a  b\nc").tolist() == quality.grams("a b c").tolist() == quality.grams("a b\x0bc").tolist()
    for text in (None, "", " \n\t"):
        assert not len(quality.grams(text)) and not plain_grams(text)


def test_long_texts_are_read_whole(monkeypatch):
    text = "some words of a text " * 3000 + "Zq&"
    whole = quality.grams(text).tolist()
    monkeypatch.setattr(quality, "RUN", 1000)
    assert quality.grams(text).tolist() == whole and len(whole) > len(quality.grams(text[:-3]))
    assert len(quality.grams("x" * 2_000_000)) < 12


def test_class_counts_and_ratios(spark):
    rows = [(i, i % 2, t) for i, t in enumerate(["aa aa", "b c", "", "b c", "é x", "aa"])]
    totals, counts = quality.class_counts(spark.createDataFrame([r[1:] for r in rows], "label int, text string").repartition(4))
    want = [Counter(), Counter()]
    for _, y, t in rows:
        want[y].update(quality.grams(t).tolist())
    assert totals.tolist() == [3, 3] and all(counts[y, f] == want[y][f] for y in (0, 1) for f in range(quality.FEATURES) if counts[y, f] or f in want[y])
    r = quality.ratios(counts)
    sums = [sum(want[y].values()) + quality.FEATURES for y in (0, 1)]
    for f in want[0] | want[1]:
        assert math.isclose(r[f], math.log((want[1][f] + 1) / sums[1]) - math.log((want[0][f] + 1) / sums[0]), abs_tol=1e-12)


def test_dual_descent_reaches_the_optimum():
    """The duality gap closes: primal and dual objective meet."""
    rng = np.random.default_rng(1)
    vectors, signs = [], np.where(rng.random(120) < 0.5, 1.0, -1.0)
    for s in signs:
        at = np.sort(rng.choice(40, 8, replace=False))
        x = rng.normal(size=8) + 0.4 * s
        vectors.append((at, x / np.sqrt(x @ x)))
    w, bias = quality.hinge(vectors, signs, 1.0, epochs=2000, tolerance=1e-6)
    margins = np.array([w[at] @ x + bias for at, x in vectors]) * signs
    primal = 0.5 * (w @ w + bias**2) + np.maximum(0, 1 - margins).sum()
    # no nearby point is better, in any of many directions
    for _ in range(300):
        d, e = np.zeros_like(w), rng.normal() * 1e-3
        d[:40] = rng.normal(size=40) * 1e-3
        other = np.array([(w + d)[at] @ x + bias + e for at, x in vectors]) * signs
        assert 0.5 * ((w + d) @ (w + d) + (bias + e) ** 2) + np.maximum(0, 1 - other).sum() >= primal - 1e-6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    y = np.array([r.quality for r in rows])
    right = np.array([r.predicted for r in rows]) == y
    assert right.mean() >= 0.97 and right[y == 0].mean() >= 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # labels of held-out documents aren't learnt from
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.judged(docs.drop("lang", "source"), flipped)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def clean(i):
    return " ".join(f"word{(i * 7 + k) % 40}" for k in range(20))


def test_odd_rows(spark):
    rows = [(i, clean(i) if i % 3 else "SPAM!! " * 10, 1, "x", "y") for i in range(300)]
    rows += [(1000, None, 1, "x", "y"), (1001, "", None, None, None), (1002, " \n", 1, "x", "y"), (None, clean(1), 1, "x", "y"), (2, "other " * 5, 1, "x", "y"), (3, rows[3][1], 1, "x", "y"), (5000, "SPAM!! " * 100_000, 1, "x", "y")]
    said = [(i, int(i % 3 > 0), 0, "t") for i in range(300)] + [(1000, 1, 0, None), (1001, None, None, None), (None, 0, 0, "t"), (7, 0, 0, "t"), (8, 1, 0, "t"), (9, 5, 0, "t"), (7777, 0, 0, "t")]
    got = quality.judged(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(said, LABELS).repartition(2)).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(r[0]), held(r[0])) for r in rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 3 > 0) for i in range(300) if i not in (2,)) and by[5000].predicted == 0 and by[None].predicted == 1
    assert by[1000].score == by[1001].score == by[1002].score


@pytest.mark.parametrize("said, want", [([], 0.5), ([(i, 1, 0, "t") for i in range(20)], None), ([(i, 0, 0, "t") for i in range(20)], None)])
def test_nothing_to_tell_apart(spark, said, want):
    docs = spark.createDataFrame([(i, clean(i), 1, "x", "y") for i in range(30)], DOCS)
    n = sum(not held(i) for i, *_ in said)
    want = want or ((n + 1) / (n + 2) if said[0][1] else 1 / (n + 2))
    assert {round(r.score, 9) for r in quality.judged(docs, spark.createDataFrame(said, LABELS)).collect()} == {round(want, 9)}
    assert quality.judged(docs.limit(0), spark.createDataFrame(said, LABELS)).collect() == []


def test_the_sample_is_bounded(spark):
    said = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("label"))
    docs = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(7)).otherwise(F.col("id") - 6000).alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    chosen = quality.sampled(said, np.array([1000, 2000]), 40)
    assert {r.label: r.n for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 20, 1: 20}
    assert len(quality.sample_vectors(docs, chosen)[0]) == 40
    found, y = quality.sample_vectors(docs, quality.sampled(said, np.array([1000, 2000]), 100_000))
    assert len(found) == 3000 and y.sum() == 2000
