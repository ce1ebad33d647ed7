"""Lists of which nothing is cut off before it has been ranked, on tables of a few rows of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import topk
from modiste.plans import profiles
from modiste.workload import all_queries


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """100 products of one category whose vectors point four ways, two suppliers whose phrases point all of these ways."""
    where = tmp_path_factory.mktemp("ways")
    rng = np.random.default_rng(5)
    tables = {
        "embeddings": ([(i, (np.eye(64)[i % 4] + rng.normal(size=64) / 100).tolist(), i % 10) for i in range(100)], "vec_id long, embedding array<float>, label int"),
        "part": ([(i, f"w{i} bolt", "Brand#1", "STANDARD", 1, 900.0) for i in range(100)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"s{i}", 0, 1000.0) for i in (1, 2)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_the_union_holds_what_every_phrase_found(spark, shop):
    got = all_queries()["topk_per_phrase_union"](spark, shop).collect()
    for query in (1, 2):
        own = sorted((r.rank, int(r.object_id[2:])) for r in got if r.query_id == query)
        assert [x[0] for x in own] == list(range(1, 81))
        assert [x[1] % 4 for x in own] == [(query + phrase) % 4 for phrase in (1, 2, 3, 4) for _ in range(20)]


@pytest.mark.parametrize("limit", [100, 7])
def test_a_blend_ranks_every_item(spark, limit):
    """The items nearest by cosine aren't the best ones: a loop over all pairs has the same."""
    rng = np.random.default_rng(7)
    asks, items = rng.normal(size=(30, 4)), rng.normal(size=(400, 4))
    wanted, facts = rng.random((30, 3)), rng.random((400, 3)).round(1)
    wanted[3], wanted[4, 1], facts[5], facts[6, 2] = np.nan, np.nan, np.nan, np.nan
    plain = lambda m: [[None if np.isnan(x) else float(x) for x in row] for row in m]
    q = spark.createDataFrame(list(zip(range(30), asks.tolist(), plain(wanted))), "query_id long, vec array<double>, facts array<double>")
    v = spark.createDataFrame([(f"p{i % 390}", x, f) for i, (x, f) in enumerate(zip(items.tolist(), plain(facts)))], "object_id string, vec array<double>, facts array<double>").repartition(5)
    got = topk.blended(q, v, 6, (0.7, 0.3), max_query_rows=limit).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine, near = np.round(unit(asks) @ unit(items).T, 6), 1 - np.abs(wanted[:, None] - facts[None])
    with np.errstate(invalid="ignore"):
        match = np.where(np.isnan(near).all(axis=2), 0.5, np.nansum(near, axis=2) / (~np.isnan(near)).sum(axis=2))
    value = np.round(0.7 * cosine + 0.3 * match, 9)
    for i in range(30):
        want = sorted((-value[i, j], f"p{j % 390}", cosine[i, j]) for j in range(400))[:6]
        held = {(r.object_id, round(r.score, 6)) for r in got if r.query_id == i}
        assert {(x[1], round(x[2], 6)) for x in want} <= held
        assert len(held) <= 6 * (1 if limit == 7 else 8)
    assert {r.object_id for r in got if r.query_id == 0} != {f"p{j % 390}" for j in np.argsort(-cosine[0])[:6]}


def test_a_session_is_given_the_best_of_all_items(spark):
    """45 items lie nearer to the user's centre than the one that fits the user's axes, and three nearest are the user's own."""
    vecs = [(f"p{i:02}", [1.0, i / 1000]) for i in range(45)] + [("fits", [1.0, 0.05])]
    v = spark.createDataFrame(vecs, "object_id string, vec array<double>")
    axis = lambda name: 1.0 if name in ("fits", "p00", "p01", "p02") else 0.0
    axes = spark.createDataFrame([(n, *[axis(n)] * len(vocab.AXES)) for n, _ in vecs], "object_id string, " + ", ".join(f"{a} double" for a in vocab.AXES))
    signals = spark.createDataFrame([("u", "save", f"p{i:02}", i, i) for i in range(3)], "user_token string, kind string, object_id string, event_id long, s long")
    signals = signals.withColumn("ts", F.timestamp_seconds("s"))
    got = profiles.rank_session(signals, v, axes, total_k=40).orderBy("rank").collect()
    assert [r.object_id for r in got][0] == "fits" and len(got) == 40
    assert not {r.object_id for r in got} & {"p00", "p01", "p02"}


def test_blocks_of_queries_meet_vectors_that_are_not_shuffled(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(f"p{i}", rng.normal(size=6).tolist()) for i in range(200)], "object_id string, vec array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(100)], "query_id long, vec array<double>")
    found = topk.scored(q, v, None, 0.4, max_query_rows=9)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == topk.scored(q, v, None, 0.4).count()
