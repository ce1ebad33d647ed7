"""The catalogue store, staged widening, the bitmap before anti-joins, and sequential walks against plain loops."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from modiste import scale
from modiste.operators import ranking, sets, vectors
from modiste.plans import training
from modiste.sources import catalog

C = F.col
SCHEMA = "object_id string, title string, price double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def items(spark, ids, price=1.0):
    return spark.createDataFrame([(f"p{i}", f"t{i}", float(price)) for i in ids], SCHEMA)


def files(folder, v):
    return {k: {f.name for f in (Path(folder) / at).iterdir() if f.suffix == ".parquet"} for k, at in v.folders.items()}


@pytest.mark.parametrize("small", [catalog.SMALL, 0])
def test_an_upsert_reads_and_writes_only_its_buckets(spark, tmp_path, monkeypatch, small):
    path = str(tmp_path / "store")
    first = catalog.create(items(spark, range(400)), path, buckets=32)
    before = files(path, first)
    ids = [3, 5, 7, 401, 402]
    touched = {r.b for r in items(spark, ids + [9]).select(catalog.bucket_of("object_id", 32).alias("b")).collect()}
    assert 1 < len(touched) < 8
    plain, opened = catalog.read, set()
    monkeypatch.setattr(catalog, "read", lambda *a: (df := plain(*a), opened.update(re.findall(r"bucket=(\d+)/", " ".join(df.inputFiles()))))[0])
    second = catalog.upsert(spark, path, items(spark, ids, 9.0), ["price"], items(spark, [9]).select("object_id"), small=small)
    monkeypatch.setattr(catalog, "read", plain)
    assert {int(x) for x in opened} == touched
    after = files(path, second)
    assert {k for k in after if after[k] != before.get(k) or second.folders[k] != first.folders.get(k)} == touched
    assert all(second.folders[k] == first.folders[k] for k in first.folders if k not in touched)
    want = [(f"p{i}", f"t{i}", 9.0 if i in ids else 1.0) for i in [*range(400), 401, 402] if i != 9]
    assert rows_of(catalog.read(spark, path)) == sorted(want, key=str)
    assert rows_of(catalog.read(spark, path, first)) == rows_of(items(spark, range(400)))  # a reader that has begun


@pytest.mark.parametrize("small", [catalog.SMALL, 0])
def test_columns_deletes_and_new_rows(spark, tmp_path, small):
    path = str(tmp_path / "store")
    catalog.create(items(spark, range(50)), path, buckets=4)
    new = spark.createDataFrame([("p1", "new", None), ("p60", "new", 5.0), ("p2", "gone", 1.0)], SCHEMA)
    catalog.upsert(spark, path, new, None, spark.createDataFrame([("p2",), ("p3",), ("p999",)], "object_id string"), small=small)
    want = [(f"p{i}", f"t{i}", 1.0) for i in range(50) if i not in (1, 2, 3)] + [("p1", "new", None), ("p60", "new", 5.0)]
    assert rows_of(catalog.read(spark, path)) == sorted(want, key=str)
    catalog.upsert(spark, path, new.select("object_id", C("price") + 1).toDF("object_id", "price").where("object_id = 'p60'"), small=small)
    assert ("p60", "new", 6.0) in rows_of(catalog.read(spark, path))
    catalog.upsert(spark, path, new.limit(0), None, catalog.read(spark, path).select("object_id"), small=small)
    assert catalog.read(spark, path).collect() == [] and catalog.upsert(spark, path, new.limit(0)).number == 4
    catalog.upsert(spark, path, items(spark, [1]), small=small)
    assert rows_of(catalog.read(spark, path)) == [("p1", "t1", 1.0)]


def test_old_versions_go_and_two_writers_dont_mix(spark, tmp_path):
    path = tmp_path / "store"
    catalog.create(items(spark, range(20)), str(path), buckets=2)
    for i in range(12):
        v = catalog.upsert(spark, str(path), items(spark, [i, 100 + i], 2.0))
    assert len(catalog.published(spark, str(path))) == 2 and catalog.read(spark, str(path)).count() == 32
    named = {at for n in catalog.published(spark, str(path)) for at in catalog.version(spark, str(path), n).folders.values()}
    assert {f"data/{d.name}/{b.name}" for d in (path / "data").iterdir() for b in d.iterdir() if b.name.startswith("bucket=")} == named
    assert all(len(x) <= catalog.MANY_FILES + 2 for x in files(path, v).values())
    with pytest.raises(RuntimeError):
        catalog._publish(spark, str(path), v)


def test_old_rows_arent_shuffled_by_a_small_upsert(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "store"), []
    catalog.create(items(spark, range(400)), path, buckets=8)
    write = catalog._write
    monkeypatch.setattr(catalog, "_write", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, *a))
    catalog.upsert(spark, path, items(spark, [1, 2, 500], 3.0))
    assert plans[0].count("RepartitionByExpression") == 1 and "FullOuter" not in plans[0] and plans[0].count("rightHint=(strategy=broadcast)") >= 2


# ── widening ──────────────────────────────────────────────────────────────────
def test_a_tier_reads_only_open_keys(spark):
    asked = spark.createDataFrame([(q,) for q in range(6)], "query_id int")
    seen = []

    def tier(name, n):
        def run(rows):
            seen.append((name, sorted(r.query_id for r in rows.collect())))
            return rows.select("query_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(0), n(C("query_id"))))).alias("rank")).select("query_id", F.concat(F.lit(name), C("rank").cast("string")).alias("object_id"), "rank")

        return run

    out = sets.fallback_widen(asked, [tier("a", lambda q: q + 0 * q + 1), tier("b", lambda q: q * 2 + 1), tier("c", lambda q: q * 0 + 2)], ["query_id"], [4, 9])
    assert seen == [("a", [0, 1, 2, 3, 4, 5]), ("b", [0, 1, 2]), ("c", [0, 1, 2])]
    got = {q: [(r.tier, r.object_id, r.pos) for r in out.where(C("query_id") == q).orderBy("pos").collect()] for q in (0, 4)}
    assert got[4] == [(0, f"a{i}", i) for i in range(1, 6)] and got[0] == [(0, "a1", 1), (1, "b1", 2), (2, "c1", 3), (2, "c2", 4)]


# ── the bitmap before anti-joins ──────────────────────────────────────────────
@pytest.mark.parametrize("buckets", [1, 64])
def test_anti_join_behind_a_bitmap(spark, buckets, monkeypatch):
    monkeypatch.setattr(scale, "FEWEST_BUCKETS", buckets)
    monkeypatch.setattr(scale, "MOST_BUCKETS", buckets)
    df = spark.range(20_000).select(F.when(C("id") % 50 > 0, C("id")).alias("user"), F.concat(F.lit("p"), C("id") % 700).alias("object_id"), C("id").alias("n"))
    seen = df.where("n % 9 = 0").select(C("user").cast("long"), "object_id", F.lit(1).alias("other")).unionByName(spark.range(3000).select((C("id") + 10**6).alias("user"), F.lit("x").alias("object_id"), F.lit(2).alias("other")))
    plain = rows_of(scale.without(df, seen, ["user", "object_id"], filtered=False))
    got = scale.without(df, seen, ["user", "object_id"], filtered=True)
    assert got.columns == df.columns and rows_of(got) == plain and any(r[0] is None for r in plain)
    assert rows_of(scale.without(df, seen.limit(0), ["user", "object_id"], filtered=True)) == rows_of(df)
    assert scale.without(df.limit(0), seen, ["user", "object_id"], filtered=True).collect() == []


def test_only_suspects_are_shuffled(spark):
    df, seen = spark.range(0, 200_000, 1, 8).toDF("object_id"), spark.range(0, 200_000, 100, 8).toDF("object_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scale.without(df, seen, ["object_id"])
        assert out.count() == 198_000
        q = out._jdf.queryExecution()
        q.executedPlan().execute().count()
        plan = q.executedPlan()
        rows, todo = [], [plan]
        while todo:
            p = todo.pop()
            todo += [p.children().apply(i) for i in range(p.children().size())]
            if p.getClass().getSimpleName() == "ShuffleExchangeExec":
                rows.append(p.metrics().apply("shuffleRecordsWritten").value())
        # 2,000 seen and 2,000 to 4,000 suspects, not 200,000
        assert sorted(rows)[0] == 2000 and 2000 <= sorted(rows)[-1] < 10_000 and len(rows) == 2, rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# ── walks ─────────────────────────────────────────────────────────────────────
def plain_promoted(novelty, stride):
    queue = list(range(len(novelty)))
    for at in range(stride - 1, len(queue), stride):
        rest = queue[at + 1 :]
        if not rest:
            break
        best = at + 1 + int(np.argmax(np.asarray(novelty)[rest]))
        if best != at + 1:
            queue.insert(at, queue.pop(best))
    return queue


def test_promotion_equals_the_plain_walk():
    rng = random.Random(1)
    for n in [*range(30), 200, 700]:
        for stride in (3, 5, 9):
            novelty = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
            assert ranking.promoted(np.array(novelty), stride) == plain_promoted(novelty, stride)
    began = time.time()
    out = ranking.promoted(np.random.default_rng(1).random(100_000), 3)
    assert sorted(out) == list(range(100_000)) and time.time() - began < 10


def plain_spread(brands, cooldown):
    queues, recent, out = {}, [], []
    for i, b in enumerate(brands):
        queues.setdefault(b, []).append(i)
    while len(out) < len(brands):
        free = [b for b in queues if queues[b] and b not in recent]
        b = max(free, key=lambda x: len(queues[x])) if free else next(x for x in recent if queues[x])
        out.append(queues[b].pop(0))
        recent = ([x for x in recent if x != b] + [b])[-cooldown:]
    return out


def test_brand_spread_equals_the_plain_walk():
    rng = random.Random(2)
    for _ in range(200):
        brands, number = [], {}
        for _ in range(rng.randint(0, 60)):
            b = rng.choice("aaaabbcdefgh"[: rng.randint(1, 12)])
            brands.append(number.setdefault(b, len(number)))
        for cooldown in (1, 2, 4):
            assert ranking.spread(brands, cooldown) == plain_spread(brands, cooldown)
    began = time.time()
    assert len(ranking.spread([i for i in range(50_000)] * 2, 4)) == 100_000 and time.time() - began < 10


def plain_leaders(rows, threshold):
    sums, counts = [], []
    for v in rows:
        best, like = -1, threshold
        for i, s in enumerate(sums):
            n = np.linalg.norm(s) * np.linalg.norm(v)
            x = s @ v / n if n else 0.0
            if x > like:
                best, like = i, x
        if best < 0:
            sums.append(v.copy())
            counts.append(1)
        else:
            sums[best] = sums[best] + v
            counts[best] += 1
    return sums, counts


@pytest.mark.parametrize("block", [1, 3, 16, 256])
def test_clustering_by_blocks_equals_the_walk(block, monkeypatch):
    monkeypatch.setattr(vectors.Leaders, "BLOCK", block)
    rng = np.random.default_rng(3)
    for n, spread, threshold in [(1, 1.0, 0.5), (40, 0.3, 0.78), (300, 0.6, 0.78), (200, 2.0, 0.3), (150, 0.5, 0.95), (60, 1.0, -0.2)]:
        rows = rng.normal(size=(6, 8))[rng.integers(6, size=n)] + spread * rng.normal(size=(n, 8))
        rows[:: 17] = 0.0
        held = vectors.Leaders(threshold, 8)
        for at in range(0, n, 37):
            held.add(rows[at : at + 37])
        sums, counts = plain_leaders(rows, threshold)
        assert held.counts.tolist() == counts and np.allclose(held.sums, np.array(sums), atol=1e-9)


def test_gradient_tiles_add_up(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [tuple([float(x) for x in rng.normal(size=20)] for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "anchor_vec array<double>, positive_vec array<double>, negative_vec array<double>").repartition(7)
    w = rng.normal(size=(20, 20))
    a, p, n = (np.array([r[i] for r in rows]) for i in range(3))
    hinge = 0.2 - np.einsum("ij,ij->i", a @ w.T, (p - n) @ w.T)
    on = hinge > 0
    want = (a @ w.T)[on].T @ (p - n)[on] + ((p - n) @ w.T)[on].T @ a[on]
    for tile in (1 << 20, 500):
        monkeypatch.setattr(training, "TILE_BYTES", tile)
        g, loss, active = training.gradient(df, w, 0.2)
        assert np.allclose(g, want, atol=1e-9) and abs(loss - hinge[on].sum()) < 1e-9 and active == on.sum()
    assert training.gradient(df.limit(0), w, 0.2)[2] == 0 and re.match("part int", training.PACKED)
