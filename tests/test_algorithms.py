"""Sequential and blocked algorithms against plain Python on small fixtures, and the large-input paths against the small ones."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from modiste.functions import scores, steer, text
from modiste.operators import ranking, topk, vectors
from modiste.scale import numbered, with_group_stats

C = F.col


def unit_rows(n, d=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_numbering_spread_equals_window(spark):
    df = spark.range(2000).select("id", F.when(C("id") % 3 == 0, "hot").otherwise((C("id") % 17).cast("string")).alias("k"), ((C("id") * 7919) % 2000).alias("o"))
    a = {(r.id, r.rn) for r in numbered(df, ["k"], ["o"], "rn", spread=False).collect()}
    b = {(r.id, r.rn) for r in numbered(df, ["k"], ["o"], "rn", spread=True).collect()}
    assert a == b and len(a) == 2000
    order = [r.id for r in numbered(df, [], [C("o").desc()], "rn").orderBy("rn").collect()]
    assert order == [r.id for r in df.orderBy(C("o").desc()).collect()]


def test_group_stats_spread_equals_window(spark):
    df = spark.range(300).select("id", (C("id") % 4).alias("k"))
    a, b = (sorted(map(tuple, with_group_stats(df, ["k"], spread=s, m=F.avg("id"), n=F.count(F.lit(1))).collect())) for s in (False, True))
    assert a == b


@pytest.mark.parametrize("limit", [20000, 5])
def test_nearest_is_exact_in_one_chunk_and_in_many(spark, limit):
    """Several batches per task; what leaves a task is bounded by queries × groups × k."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    v, q = unit_rows(200), unit_rows(12, seed=2)
    v[50:120] = v[50]  # a third of the items are copies of one
    vs = spark.createDataFrame([(f"p{i:03d}", "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "object_id string, g string, vec array<double>")
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vec array<double>")
    try:
        got = {(r.query_id, r.g, r["rank"]): r.object_id for r in topk.nearest(qs, vs, 7, group="g", max_query_rows=limit).collect()}
        left = topk.scored(qs, vs.repartition(3), 7, group="g", max_query_rows=limit).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert left <= 3 * 12 * 2 * 7
    s = np.round(q @ v.T, 6)
    for i in range(12):
        for g in (0, 1):
            ids = [j for j in range(200) if j % 2 == g]
            best = sorted(ids, key=lambda j: (-s[i, j], f"p{j:03d}"))[:7]
            assert [got[i, "ab"[g], r + 1] for r in range(7)] == [f"p{j:03d}" for j in best]


def test_mmr_matches_greedy_loop(spark):
    v, rng = unit_rows(40), np.random.default_rng(3)
    rows = [(1, "top", f"p{i:02d}", float(rng.random()), f"b{i % 5}", None if i % 11 == 0 else v[i].tolist(), 0.4) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, category string, object_id string, score double, brand string, vec array<double>, lam double")
    got = [r.object_id for r in ranking.mmr(df, 12).orderBy("mmr_pos").collect()]
    pool, out = sorted(rows, key=lambda r: (-r[3], r[2])), []
    while len(out) < 12:
        def value(r):
            sims = [float(np.dot(r[5], s[5])) for s in out if r[5] is not None and s[5] is not None]
            return r[3] - 0.4 * max([0.0, *sims]) - (0.15 if any(s[4] == r[4] for s in out) else 0)
        best = max(pool, key=value)
        out.append(best)
        pool.remove(best)
    assert got == [r[2] for r in out]
    plain = ranking.mmr(df.withColumn("lam", F.lit(0.0)), 12).orderBy("mmr_pos").collect()
    assert [r.object_id for r in plain] == [r[2] for r in sorted(rows, key=lambda r: (-r[3], r[2]))[:12]]


def test_greedy_cluster(spark):
    v = unit_rows(30, 4)
    rows = [(k, i, v[(i + k) % 30].tolist()) for k in range(3) for i in range(20)] + [(9, 0, [2.0, 0.0, 0.0, 0.0])]
    got = vectors.greedy_cluster(spark.createDataFrame(rows, "query_id long, ord long, vec array<double>"), "query_id", ["ord"], 0.5).collect()
    for k in range(3):
        sums, counts = [], []
        for i in range(20):
            x = v[(i + k) % 30]
            sims = [float(s @ x / np.linalg.norm(s)) for s in sums]
            if sims and max(sims) > 0.5:
                j = int(np.argmax(sims))
                sums[j], counts[j] = sums[j] + x, counts[j] + 1
            else:
                sums.append(x.copy())
                counts.append(1)
        assert sorted(counts, reverse=True) == [r["size"] for r in sorted((r for r in got if r.query_id == k), key=lambda r: r.cluster)]
    alone = [r for r in got if r.query_id == 9]
    assert len(alone) == 1 and alone[0].vec == [2.0, 0.0, 0.0, 0.0] and alone[0].weight == 1.0


def test_spread_brand_keeps_all_rows_and_distance(spark):
    rows = [("x", f"p{i:02d}", "A" if i < 10 else f"B{i % 6}", "", i + 1) for i in range(40)]
    out = ranking.spread_brand(spark.createDataFrame(rows, "lane string, object_id string, brand string, retailer string, pos long").selectExpr("*", "0 AS page"), ["lane"], "page", cooldown=3).orderBy("new_pos").collect()
    brands = [r.brand_key for r in out]
    assert sorted(r.object_id for r in out) == sorted(r[1] for r in rows) and [r.new_pos for r in out] == list(range(1, 41))
    assert all(brands[i] not in brands[i + 1:i + 4] for i in range(20))


def test_wildcards_are_a_permutation(spark):
    rng = np.random.default_rng(5)
    rows = [("u", f"c{i:02d}", i + 1, float(rng.random()), 0.75) for i in range(30)]
    out = ranking.wildcards(spark.createDataFrame(rows, "user_token string, card_id string, pos long, p_comment double, explore double"), ["user_token"]).orderBy("new_pos").collect()
    queue = list(rows)
    for at in range(4, 30, 5):  # stride 9 - 6·0.75 rounded half up = 5
        if at + 1 >= len(queue):
            break
        best = max(range(at + 1, len(queue)), key=lambda i: (queue[i][3], -i))
        if best != at + 1:
            queue.insert(at, queue.pop(best))
    assert [r.card_id for r in out] == [r[1] for r in queue]


def test_pick_diverse_matches_full_walk(spark):
    rng = np.random.default_rng(7)
    rows = [("e", f"p{i:03d}", f"c{rng.integers(4)}", f"b{rng.integers(6)}", f"t{rng.integers(30)}", i) for i in range(300)]
    out = ranking.pick_diverse(spark.createDataFrame(rows, "edit string, object_id string, category string, brand string, title string, pos long"), ["edit"], size=20, brand_cap=4).orderBy("slot").collect()
    cats = {}
    for r in sorted(rows, key=lambda r: r[5]):
        cats.setdefault(r[2], []).append(r)
    lists, per, seen, want = [sorted(v, key=lambda r: r[1]) for v in cats.values()], {}, set(), []
    moved = True
    while moved and len(want) < 20:
        moved = False
        for q in lists:
            if len(want) >= 20:
                break
            while q:
                r = q.pop(0)
                if per.get(r[3], 0) >= 4 or (r[3], r[4]) in seen:
                    continue
                seen.add((r[3], r[4]))
                per[r[3]] = per.get(r[3], 0) + 1
                want.append(r[1])
                moved = True
                break
    assert [r.object_id for r in out] == want


def test_boundaries(spark):
    prices = [(None,), (0.0,), (49.99,), (50.0,), (149.99,), (150.0,)]
    df = spark.createDataFrame(prices, "price double")
    assert [r[0] for r in df.select(scores.price_bucket(C("price"))).collect()] == ["unknown", "unknown", "budget", "mid", "mid", "luxury"]
    dwell = spark.createDataFrame([(500.0,), (8000.0,), (2000.0,)], "ms double").select(F.round(scores.dwell_score(C("ms")), 6)).collect()
    assert [r[0] for r in dwell] == [0.0, 1.0, 0.5]
    s = spark.createDataFrame([("Under $200, no florals but denim",), ("",), ("edgier",)], "t string").select(steer.steer_parse(C("t")).alias("s")).select("s.*").collect()
    assert s[0].price_range == "mid" and s[0].avoid_terms == ["floral", "florals"] and s[0].is_concrete
    assert not s[1].is_concrete and s[2].is_abstract and not s[2].is_concrete
    d = spark.createDataFrame([("a &amp; b &#8211; &#x41; \\u0042 &nope;",)], "t string").select(text.decode_entities(C("t"))).first()[0]
    assert d == "a & b – A B &nope;"


def test_vendor_csv_file(spark, tmp_path):
    from modiste.sources import feeds

    p = tmp_path / "feed.csv"
    p.write_text("﻿data_0,price_0,image_0,options_values_0,description_0,data-page-selector\n"
                 '"Silk ""Maxi"" Dress",$49.50,https://i.example.com/a.jpg,Red,"two\nlines",https://s.example.com/1\n,$5,,,,https://s.example.com/2\nNo url,$5,,,,\n', encoding="utf-8")
    rows = feeds.vendor_csv(feeds.read_vendor_csv(spark, str(p)), "edikted", "Shop").collect()
    assert len(rows) == 1 and rows[0].title == 'Silk "Maxi" Dress' and rows[0].price == 49.5 and rows[0].category == "dress" and rows[0].description == "two\nlines"
    assert rows[0].aesthetic_tags == ["bohemian", "romantic", "elegant", "red", "maxi"]


def test_streams_over_many_batches_equal_batch(spark, tmp_path):
    from modiste.streaming import jobs

    rng = np.random.default_rng(9)
    rows = [(i, f"u{rng.integers(3)}", f"p{rng.integers(20)}", datetime(2024, 1, 1) + timedelta(minutes=i), "u|d", float(rng.integers(100, 3000)), ["like", "click", "dislike", "impression"][rng.integers(4)]) for i in range(600)]
    schema = "event_id long, user_token string, object_id string, ts timestamp, session_id string, dwell_ms double, kind string"
    for part in range(3):
        spark.createDataFrame(rows[part * 200:(part + 1) * 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    full = spark.createDataFrame(rows, schema)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))

    def same(a, b, cols):
        assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))

    same(jobs.session_buffers(stream()), jobs.session_buffers_batch(full), ["user_token", "buffer", "event_id", "rank"])
    same(jobs.dwell_dislikes(stream()), jobs.dwell_dislikes_batch(full), ["user_token", "event_id", "rank"])
    steers = full.where("kind = 'like'").select(C("event_id").alias("steer_id"), "user_token", "ts")
    spark.createDataFrame([(None, "u", None, datetime(2025, 1, 1), None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    same(jobs.steer_outcomes(stream(), C("kind") == "like").where("steer_id IS NOT NULL"), jobs.steer_outcomes_batch(full.where("kind <> 'like'"), steers), ["steer_id", "outcome", "n"])


def test_training_improves_held_out_triplets(spark):
    from modiste.plans import training

    rng = np.random.default_rng(4)
    ids = [(f"p{i}", [float(x) for x in np.r_[np.eye(2)[i % 2] * 0.3, rng.normal(size=4)]]) for i in range(60)]
    vs = spark.createDataFrame(ids, "object_id string, vec array<double>")
    items = spark.createDataFrame([(f"r{r}", f"p{i}", i % 2 == r % 2) for r in range(10) for i in range(60)], "run_id string, object_id string, kept boolean")
    t = training.triplets(items, "s")
    rows = t.collect()
    assert len(rows) == 400 and all(r.anchor != r.positive for r in rows)
    w, losses = training.train_projection(training.with_vectors(t, vs), 6, epochs=6, lr=2.5, batch_rows=200)
    before, after = (training.accuracy(t, vs, m).first().accuracy for m in (None, w))
    assert losses[-1] < losses[0] and after > before
