"""Pools move with vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from modiste.functions import vec
from modiste.operators import ranking


def test_unit_rows_of_packed_vectors(spark):
    rows = [[3.0, 4.0], None, [0.1, 0.2], [0.0, 0.0], [1.0, float("nan")]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v array<double>").coalesce(1)
    packs = df.select(vec.packed("v").alias("p")).toArrow().column("p").combine_chunks()
    got = ranking.unit_rows(packs.slice(0, 4))
    assert np.allclose(got, [[0.6, 0.8], [0, 0], np.array([0.1, 0.2]) / np.hypot(0.1, 0.2), [0, 0]])
    assert np.allclose(ranking.unit_rows(packs.slice(2, 2)), got[2:])
    assert ranking.unit_rows(packs.slice(1, 1)).tolist() == [[0.0]] and ranking.unit_rows(pa.array([], pa.binary())).shape[0] == 0


def test_mmr_shuffles_bytes(spark):
    scored = spark.createDataFrame([(1, "dress", f"p{i}", i / 10, "b", [float(i), 1.0]) for i in range(4)], "query_id long, category string, object_id string, score double, brand string, vec array<double>")
    out = ranking.mmr(scored, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert "packed" in plan and "packed" in plan[plan.index(below):]
    assert [r.object_id for r in out.orderBy("mmr_pos").collect()][0] == "p3"
