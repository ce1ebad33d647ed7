"""The near-dedup stage takes candidates from the fingerprints' index and links what is alike."""

from __future__ import annotations

import numpy as np

from modiste.llm import nearcopies, simhash


def test_close_and_equal_fingerprints_are_candidates(spark):
    far = 0x5555555555555555
    rows = [(1, 0b1000, [1]), (2, 0b1011, [2]), (3, 0b1000, [3]), (4, far, [4]), (5, 0b1000, [])]
    first = spark.createDataFrame(rows, "a long, fp long, bands array<long>")
    assert sorted(map(tuple, nearcopies.fingerprint_stars(first).distinct().collect())) == [(1, 2), (1, 3)]


def test_fingerprints_are_those_of_the_operator(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (0, 1, 4, 5, 9, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.int64(r.fp).view(np.uint64) for r in nearcopies.signed(docs, 5).collect()}
    assert [got[i] for i in range(len(texts))] == list(simhash.fingerprints([t.encode() for t in texts], 5))
