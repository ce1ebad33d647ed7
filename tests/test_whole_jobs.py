"""Queries that give all their rows, on tables of a few rows of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modiste.operators import ranking, topk
from modiste.streaming import jobs
from modiste.workload import all_queries

C = F.col


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """100 vectors that are nearly one, 100 products of one word, six suppliers, two of which ask for the same."""
    where = tmp_path_factory.mktemp("shop")
    rng = np.random.default_rng(8)
    vecs = [(i, (np.ones(64) + rng.normal(size=64) / 10).tolist(), i % 10) for i in range(100)]
    parts = [(i, "new bolt" if i in (1, 4) else f"w{i} bolt", f"Brand#{i % 25 + 1}", "STANDARD", 1, 900.0) for i in range(100)]
    tables = {
        "embeddings": (vecs, "vec_id long, embedding array<float>, label int"),
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"s{i}", 0, 1000.0 * i) for i in range(1, 7)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_cross_knn_gives_every_pair_above_the_floor(spark, shop):
    got = all_queries()["join_cross_knn"](spark, shop).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 100 for i in range(1, 7)}


def test_pairs_above_a_floor_are_the_same_in_many_chunks(spark):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(f"p{i}", rng.normal(size=8).tolist()) for i in range(90)], "object_id string, vec array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "query_id long, vec array<double>")
    one, many = (sorted(map(tuple, topk.scored(q, v, None, 0.1, max_query_rows=n).collect())) for n in (100, 9))
    assert one == many and len(one) > 25 * 40 / 2


def test_the_broad_tier_gives_every_product_of_the_word(spark, shop):
    got = all_queries()["set_fallback_widen"](spark, shop).collect()
    for query in range(1, 7):
        own = sorted((r.pos, r.tier, int(r.object_id[2:])) for r in got if r.query_id == query)
        first = [1, 4] if query in (1, 4) else [query]
        assert [x[2] for x in own] == first + [i for i in range(100) if i not in first]
        assert [x[0] for x in own] == list(range(1, 101)) and [x[1] for x in own] == [0] * len(first) + [2] * (100 - len(first))


class Held:
    """A list state with what was written to it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def getListState(self, *_, **__):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def registerTimer(self, at):
        self.timer = at


def frame(rows, columns):
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))


def test_likes_of_a_state_are_written_and_read_in_bulk():
    state, job = Held(), jobs.FirstLikes(1000)
    job.init(state)
    columns = ["user_token", "object_id", "ts", "event_id", "like"]
    likes = frame([(f"u{i % 7}", f"p{i}", 100, i, True) for i in range(1200)], columns)
    assert sum(len(x) for x in job.handleInputRows((0,), iter([likes]), None)) == 0 and state.calls == 1
    fast = frame([("u0", "p0", 99, 1, False), ("u0", "p0", 100, 2, False), ("u1", "p0", 100, 3, False), ("u1", "p1", 50, 4, True), ("u1", "p1", 60, 5, False)], columns)
    assert [x for out in job.handleInputRows((0,), iter([fast]), None) for x in out["event_id"]] == [1, 3]
    assert state.calls == 3 and state.rows[-1] == (["u1"], ["p1"], [50])


def test_lists_of_many_users_are_written_at_once():
    state, job = Held(), jobs.Buffers({"click": 2}, 1000)
    job.init(state)
    rows = frame([(f"u{i % 300}", "click", 0, 1000 * i, i, f"p{i}") for i in range(900)], ["user_token", "buffer", "part", "ts", "event_id", "object_id"])
    (out,) = job.handleInputRows((0,), iter([rows]), None)
    assert state.calls == 1 and len(state.rows) == 300 and len(out) == 600 and state.timer == 600 + 1000
    assert sorted(out.loc[out["user_token"] == "u5", "event_id"]) == [305, 605]


def test_brands_go_to_the_users(spark):
    users = spark.createDataFrame([("u1", None, [1.0, 0.0]), ("u2", "old", [0.0, 2.0]), ("u3", None, None)], "user_token string, age_key string, vec array<double>")
    brands = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "brand string, vec array<double>")
    ages = spark.createDataFrame([("B", ["young"])], "brand string, preferred_ages array<string>")
    got = ranking.brands_by_taste(users, brands, ages)
    assert sorted((r.user_token, r["rank"], r.brand, r.score) for r in got.collect()) == [("u1", 1, "A", 1.0), ("u1", 2, "B", 0.0), ("u2", 1, "B", 0.5), ("u2", 2, "A", 0.0)]
