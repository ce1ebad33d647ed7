"""Similarities of many rows at once, and groups that lie together."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modiste.functions import vec
from modiste.operators import ranking

ROWS = [([1.0, 2.0, 3.0], [0.5, -1.0, 2.0]), ([0.1, 0.2], [0.3, 0.7]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0]), ([1.0], None), ([1.0, None], [1.0, 2.0]),
        ([1.0, 2.0], [1.0, 2.0, 3.0]), ([0.0], [1.0, 2.0]), ([], []), ([float("nan"), 1.0], [1.0, 1.0]), ([1e-200, 0.0], [1e-200, 0.0])]


def test_cosine_rows_are_cosines(spark):
    rng = np.random.default_rng(1)
    rows = ROWS + [(np.float32(rng.normal(size=64)).tolist(), rng.normal(size=64).tolist()) for _ in range(50)]
    rows += [(rng.normal(size=64).tolist(), rng.normal(size=64).tolist()) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<double>, b array<double>")
    want = [r.c for r in df.select("i", vec.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    rows_of = df.select("i", vec.packed("a").alias("a"), vec.packed("b").alias("b")).orderBy("i").collect()
    a, b = (pa.array([None if r[k] is None else bytes(r[k]) for r in rows_of], pa.binary()) for k in ("a", "b"))
    for at in (0, 3):
        values, known = vec.cosine_rows(a.slice(at), b.slice(at))
        assert str([x if k else None for x, k in zip(values.tolist(), known)]) == str(want[at:])


def test_rounding_is_sparks(spark):
    values = [0.1499995, 0.15, 0.1499994999, -0.0000005, 0.0000005, 1.0000015, 0.2500005, float("nan")]
    want = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("x")).collect()]
    assert str((ranking.half_up(np.array(values), 6) + 0.0).tolist()) == str([x + 0.0 for x in want])


def test_groups_cross_batches():
    keys = [1, 1, None, None, 2, 2, 2, 3]
    rows = pa.record_batch({"k": pa.array(keys), "c": ["a"] * 8, "v": list(range(8))})
    for step in (1, 3, 8):
        got = [b.column("v").to_pylist() for b in ranking.groups_of([rows.slice(i, step) for i in range(0, 8, step)], 2)]
        assert got == [[0, 1], [2, 3], [4, 5, 6], [7]]


@pytest.mark.parametrize("parts", [1, 4])
def test_pools_need_no_frame_for_each_group(spark, parts):
    """A pool of many small groups leaves in a few batches, with the picks of each."""
    rows = [(q, c, f"p{i}", float(i % 5), "b" if i % 2 else None, [1.0, float(i)] if i % 3 else None) for q in [None, *range(40)] for c in ("x", "y") for i in range(6)]
    df = spark.createDataFrame(rows, "query_id long, category string, object_id string, score double, brand string, vec array<double>").repartition(parts)
    out = ranking.mmr(df, 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert len(got) == 41 * 2 * 4
    assert all(r.object_id == "p4" for r in got if r.mmr_pos == 1)
    assert {(r.object_id, r.mmr_pos) for r in got if r.query_id is None and r.category == "x"} == {(r.object_id, r.mmr_pos) for r in got if r.query_id == 7 and r.category == "y"}
