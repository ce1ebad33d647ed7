"""Very long texts, ties and repeated rows for the operators that had no such case; training against plain loops."""

from __future__ import annotations

import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from modiste.llm import decontaminate, langid, lines, sharding, simhash, suffix

LONG = "A few words of a very long text, " * 120_000
FOLDER = "/root/testdata/sf0.001"


def test_simhash_of_long_texts(frame):
    rows = [(3, LONG), (1, LONG + "end"), (2, "short"), (2, "short"), (9, "x" * 3_000_000), (8, "x" * 3_000_000)]
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.grouped(frame(rows)).collect()}
    want = brute.near_groups([r for r in rows if r[0] != 3 or r[1] != LONG[:3]])
    assert {(d, fp & 0xFFFFFFFFFFFFFFFF, c) for d, fp, c in got} == {(d, fp, c) for d, (fp, c) in want.items()}


def test_lines_of_long_texts(frame):
    rows = [(i, "shared line\n" + f"own {i}\n" * 50_000 + "y" * 1_000_000) for i in range(11)] + [(50, "\n" * 300_000), (51, "SHARED line")]
    out = lines.dropped_lines(frame(rows), bits=1 << 20)
    got = sorted((r.doc_id, r["__lines"].n_lines, r["__lines"].n_dropped, r["__lines"].text) for r in out.collect())
    assert got == sorted(brute.line_dedup(rows))


def test_sharding_of_long_texts(frame):
    rows = [(i, "z" * (1_000_000 if i % 7 == 0 else 10)) for i in range(40)] + [(0, "z" * 10), (5, None), (5, None)]
    out = sharding.sharded(frame(rows)).collect()
    assert len(out) == len(rows) and sorted(r.size for r in out) == sorted(len(t or "") + 8 for _, t in rows)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(24))


def test_long_texts_are_cut_and_matched(frame, spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=400_000))
    rows = [(1, text), (2, "start " + text[1000:200_000] + " end"), (3, None)]
    out = suffix.without_repeats(frame(rows), 50, 1 << 22).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), "__cut.n_removed", "__cut.n_spans", F.sha2("__cut.kept", 256))
    assert sorted(map(tuple, out.collect())) == sorted(brute.substrings(rows))
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    docs = [(1, LONG + " ".join(f"W{i}" for i in range(20)) + " " + LONG)]
    got = decontaminate.contamination(frame(docs).select("doc_id", "text"), items).collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(20, 1, False)]


def plain_ftrl(vectors, labels, n_langs, epochs, alpha, beta, l1, l2):
    """One weight after the other."""
    z, n = {}, {}

    def weight(f, c):
        v = z.get((f, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((f, c), 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            at, x = vectors[i]
            w = {(f, c): weight(f, c) for f in at.tolist() for c in range(n_langs)}
            score = [sum(v * w[f, c] for f, v in zip(at.tolist(), x.tolist())) for c in range(n_langs)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            for c in range(n_langs):
                p = e[c] / sum(e) - (c == labels[i])
                for f, v in zip(at.tolist(), x.tolist()):
                    g, had = v * p, n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * w[f, c]
                    n[f, c] = had + g * g
    return {k: weight(*k) for k in z}


def test_ftrl_equals_plain_loops():
    rng = np.random.default_rng(5)
    vectors, labels = [], rng.integers(0, 3, 60)
    for y in labels:
        at = np.sort(rng.choice(40, 6, replace=False) + 40 * int(rng.random() < 0.5) * int(y))
        x = rng.random(6)
        vectors.append((at, x / np.sqrt(x @ x)))
    got = langid.ftrl(vectors, labels, 3, 3, 2.0, 1.0, 0.02, 0.05)
    want = plain_ftrl(vectors, labels, 3, 3, 2.0, 1.0, 0.02, 0.05)
    assert all(abs(got[f, c] - w) < 1e-12 for (f, c), w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values()) > 0


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 4, 400)
    logits = rng.normal(size=(400, 4)) + 1.5 * np.eye(4)[labels]
    rest = 1 / 402
    target = np.full((400, 4), rest / 3)
    target[np.arange(400), labels] = 1 - rest
    loss = lambda t: -(target * np.log(langid.softmax(logits / t))).sum(1).mean()
    t = langid.calibrated(logits, labels)
    assert all(loss(t) <= loss(x) + 1e-6 for x in np.exp(np.linspace(np.log(0.02), np.log(20), 400)))


def test_languages_of_repeated_long_and_tied_rows(spark, frame):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    first = docs.where("text IS NOT NULL").first()
    odd = [(first.doc_id, first.text, first.lang)] * 30 + [(None, first.text, first.lang)] * 20 + [(7_000_000, first.text * 400, None), (7_000_001, "q" * 1_000_000, "en"), (7_000_002, "Ω", "xx"), (7_000_003, "Ω", "yy")]
    rows = docs.union(spark.createDataFrame(odd, "doc_id long, text string, lang string")).repartition(5)
    got = langid.identified(rows).collect()
    assert len(got) == docs.count() + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 12)))
    assert by[first.doc_id] == by[None] and len(by[first.doc_id]) == 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, langid.identified(rows.repartition(2)).collect()), key=str)


@pytest.mark.parametrize("min_score", [0.5, 0.9])
def test_accepted_rows_are_those_the_model_is_sure_of(spark, min_score):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.trained(docs.where(~langid.held_out()))
    want = sorted(r.doc_id for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= min_score)
    assert sorted(r.doc_id for r in langid.accepted(docs, min_score).collect()) == want
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs.where(langid.held_out()).collect())


def test_the_language_sample_is_bounded(spark, monkeypatch):
    seen = []
    plain = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda vectors, *a: seen.append(len(vectors)) or plain(vectors, *a))
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 900).cast("string"), F.lit(" und so")).alias("text"), F.when(F.col("id") % 3 > 0, "de").otherwise("en").alias("lang"))
    langid.trained(rows, sample=100)
    assert seen and seen[0] <= 80
