"""The pipeline's stages against plain loops, each on its own input, and what is registered."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
#: with names that stages might use themselves
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, gone int, __row int, drop int, `left` int, __lang int"


@pytest.fixture(scope="module")
def rows(spark):
    got = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    passage = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(2).collect()]
    got += [(5000 + i, t, lang, None, 0) for i, (t, lang) in enumerate([(None, "en"), ("", None), ("12 34", "en"), (passage[0], "en"), (got[0][1] + " " + passage[1], "en"), (got[0][1], "en"), (got[0][1] + "\n" + "the of and in", None)])]
    got += [(6000 + i, f"{got[i][1]}\nThe same  line in all", "en", "src0", 0) for i in range(12)]
    return [(*r, 7, 6, 5, 4, 3, 2) for r in got]


@pytest.fixture(scope="module")
def outputs(spark, rows):
    docs, out = spark.createDataFrame(rows, COLUMNS).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        out.append((name, [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()], docs.columns))
    return {name: x for name, *x in out}


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def test_columns(outputs):
    names = [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    assert [list(x[2]) for x in outputs.values()][:4] == [names] * 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_language_id(outputs):
    before, after, _ = outputs["language_id"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert {5000, 5001, 5002} <= gone and len(gone) < 0.03 * len(before) + 3 and set(after) <= set(before)


def test_line_dedup(outputs):
    before, after, _ = outputs["line_dedup"]
    want = [(d, t, *r[2:4], len(t), *r[5:]) for r, (d, _, _, t) in zip(before, brute.line_dedup([r[:2] for r in before]))]
    assert same(after, want) and not any("The same  line" in r[1] for r in after)


def test_near_dedup(outputs):
    before, after, _ = outputs["near_dedup"]
    first = brute.shingle_groups([r[:2] for r in before])
    assert same(after, [r for r in before if first[r[0]] == r[0]]) and 5005 not in {r[0] for r in after}


def test_decontamination(spark, outputs):
    before, after, _ = outputs["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    bad = brute.contamination([r[:2] for r in before], items)
    assert same(after, [r for r, b in zip(before, bad) if not b[-1]]) and 5003 not in {r[0] for r in after}


def test_bpe(outputs):
    before, after, columns = outputs["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = {c: i for i, c in enumerate(columns)}
    assert same([r[:11] for r in after], before)
    for r in after:
        ids = library.encode(r[1], add_special_tokens=False).ids
        assert r[at["ids"]] == ids and r[at["n_tokens"]] == len(ids)
        assert r[at["ids_sha256"]] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r[at["decoded_sha256"]] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_input(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).collect() == []


def test_registered(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert {k.split("_")[0] for k in q} >= {f"op{n}" for n in range(1, 14)} and "pipeline" in q
    assert {"op5_decontaminate", "op7_topk", "op8_lines", "op11_trie"} <= set(o)


@pytest.mark.parametrize("key", ["op5_decontaminate", "op7_topk", "op8_lines", "op11_trie"])
def test_twins(spark, key):
    import __spark_entry__ as entry
    import oracle

    ok, msg = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, key, entry.queries()[key], entry.oracle_sql()[key])
    assert ok, msg


@pytest.mark.parametrize("key", ["op1_bpe", "op2_suffix", "op3_lm", "op4_simhash", "op6_sharding", "op9_langid", "op10_html", "op13_quality"])
def test_whole_tables(spark, key):
    import __spark_entry__ as entry

    out = entry.queries()[key](spark, FOLDER)
    name = "pages" if key == "op10_html" else "documents"
    assert out.count() == spark.read.parquet(f"{FOLDER}/{name}.parquet").count()
    assert not out.where(F.col(out.columns[0]).isNull()).count()
