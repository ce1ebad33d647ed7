"""Many queries meet the vectors in blocks: their vectors don't pass through the driver, and the pairs are those of few queries."""

from __future__ import annotations

import numpy as np
import pytest

from modiste.operators import topk


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(f"p{i % 290}", rng.normal(size=6).tolist(), "ab"[i % 2]) for i in range(300)] + [("none", None, "a")], "object_id string, vec array<double>, g string")
    asks = spark.createDataFrame([(None if i == 7 else i % 95, rng.normal(size=6).tolist()) for i in range(100)] + [(200, None), (201, [0.0] * 6)], "query_id long, vec array<double>")
    return asks, items


@pytest.mark.parametrize("k, floor, group", [(5, None, None), (5, 0.3, "g"), (None, 0.4, None), (None, -1.0, "g")])
def test_blocks_give_the_same_pairs(rows, k, floor, group, monkeypatch):
    asks, items = rows

    def found(limit):
        if k is None:
            df = topk.scored(asks, items, None, floor, group=group, max_query_rows=limit)
        else:
            df = topk.nearest(asks, items, k, floor, group=group, max_query_rows=limit)
        return sorted(map(str, df.collect()))

    few = found(1000)
    sent, broadcast = [], type(asks.sparkSession.sparkContext).broadcast
    monkeypatch.setattr(type(asks.sparkSession.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    assert found(9) == few and few
    assert not sent
