import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of (doc_id, text) with columns that clash with the names operators use."""

    def make(rows):
        rows = [(*r, "x", 1, 2, [3], "y") for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, key string, h long, n_lines int, ids array<int>, term string").repartition(3)

    return make
