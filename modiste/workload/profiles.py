"""Registered queries of profiles, pair generation, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import vec
from modiste.plans import profiles, training
from modiste.scale import first_k
from modiste.workload.aggregates import long_vec, unit_wmean
from modiste.workload.fixtures import AS_OF, query, quoted
from modiste.workload.joins import PICKS, picks
from modiste.workload.ranking import RAW_UNIT, SESSION, center, user_vectors
from modiste.workload.vectors import ENTRIES, STYLES, styles, unit_rows

C = F.col


def age_centroids(e):
    units = e.vectors.withColumn("vec", vec.normalize(C("vec"))).join(e.products.select("object_id", "category"), "object_id")
    keyed = units.withColumn("age_key", F.concat(F.lit("age-"), C("label").cast("string"))).where("NOT (category = 'bag' AND label > 4)")
    return vec.mean_by(keyed, ["category", "age_key"])


def age_wishes(e):
    """Every user asks for the age key of its own vector's style, in the category of its own product."""
    v = e.vectors.select(F.concat(F.lit("u-"), C("vec_id").cast("string")).alias("user_token"), F.concat(F.lit("age-"), C("label").cast("string")).alias("age_key"), "object_id")
    return v.join(e.products.select("object_id", "category"), "object_id").select("user_token", "age_key", "category")


AGES = """ae AS (SELECT category, label, i, avg(x) AS m FROM (SELECT category, label, unnest(vec) AS x, unnest(range(64)) AS i FROM units JOIN products USING (object_id) WHERE NOT (category = 'bag' AND label > 4)) GROUP BY 1, 2, 3),
    ac AS (SELECT category, label, i, m / sqrt(sum(m * m) OVER (PARTITION BY category, label)) AS x FROM ae), an AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM (SELECT label, i, avg(x) AS m FROM ac GROUP BY 1, 2)),
    aw AS (SELECT concat('u-', CAST(vec_id AS VARCHAR)) AS user_token, label, category FROM vectors JOIN products USING (object_id)),
    av AS (SELECT user_token, n.i, coalesce(c.x, n.x) AS x FROM aw JOIN an n USING (label) LEFT JOIN ac c ON c.category = aw.category AND c.label = aw.label AND c.i = n.i)"""


@query("prof_age_resolve", f"WITH {AGES} SELECT user_token, CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS x FROM av")
def _(e):
    return long_vec(profiles.age_resolve(age_wishes(e), age_centroids(e)), "user_token")


INFER_U = """us AS (SELECT user_token, s.vec AS vec, round(list_cosine_similarity(t.tvec, s.vec), 6) + 0.0 AS w, row_number() OVER (PARTITION BY user_token ORDER BY round(list_cosine_similarity(t.tvec, s.vec), 6) + 0.0 DESC, CAST(label AS VARCHAR)) AS rn FROM tv t, st s),
    ui AS (SELECT user_token, vec, w FROM us WHERE rn <= 2 AND w > 0)"""
PARTS = f"""{SESSION}, {AGES}, {STYLES}, {INFER_U}, iv AS ({RAW_UNIT.format(src='ui')}), pu AS (SELECT user_token, i, x, CAST(1.0 AS DOUBLE) AS w FROM te UNION ALL SELECT user_token, i, x, 0.4 FROM av UNION ALL SELECT user_token, i, x, 0.8 FROM c1 UNION ALL SELECT user_token, i, x, 0.3 FROM iv)"""


@query("prof_user_vector", f"WITH {PARTS} {unit_rows('(SELECT user_token, i, sum(x * w) / sum(w) AS m FROM pu GROUP BY 1, 2)', 'user_token')}")
def _(e):
    uploads, _ = user_vectors(e)
    sessions = profiles.session_centroid(e.signals, e.vectors)
    return long_vec(profiles.user_vector(uploads, profiles.age_resolve(age_wishes(e), age_centroids(e)).select("user_token", "vec"), sessions, styles(e)), "user_token")


@query("prof_fallback_chain", f"""WITH {SESSION}, {AGES}, au AS (SELECT user_token FROM aw), p AS (SELECT user_token, i, CASE WHEN c1.x IS NOT NULL THEN 'session' WHEN te.x IS NOT NULL THEN 'upload' ELSE 'age' END AS source, coalesce(c1.x, te.x, av.x) AS x
      FROM av LEFT JOIN c1 USING (user_token, i) LEFT JOIN te USING (user_token, i)) SELECT user_token, source, CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS x FROM p""")
def _(e):
    uploads, _ = user_vectors(e)
    ages = profiles.age_resolve(age_wishes(e), age_centroids(e))
    out = profiles.fallback_chain(age_wishes(e), ("session", profiles.session_centroid(e.signals, e.vectors)), ("upload", uploads), ("age", ages))
    return long_vec(out, "user_token", "source")


@query("prof_preference_pairs", f"""WITH {PICKS}, b AS (SELECT user_token, a.vec AS pv, r.vec AS rv FROM picks JOIN vectors a ON a.object_id = picked JOIN vectors r ON r.object_id = rejected),
    x AS (SELECT user_token, unnest(pv) AS p, unnest(rv) AS r, unnest(range(64)) AS i FROM b) {unit_rows('(SELECT user_token, i, avg(p) - 0.3 * avg(r) AS m FROM x GROUP BY 1, 2)', 'user_token')}""")
def _(e):
    return long_vec(profiles.preference_vector(picks(e), e.vectors), "user_token")


@query("prof_recent_n", "SELECT user_token, event_id, rn FROM (SELECT user_token, event_id, row_number() OVER (PARTITION BY user_token ORDER BY ts DESC, event_id DESC) AS rn FROM signals WHERE kind = 'click') WHERE rn <= 15")
def _(e):
    return profiles.recent_n(e.signals.where("kind = 'click'"), 15).select("user_token", "event_id", "rn")


@query("prof_cached_latest", f"SELECT user_token, object_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_token, object_id ORDER BY ts DESC, event_id DESC) AS rn FROM signals WHERE kind = 'save' AND ts >= TIMESTAMP {quoted(AS_OF)} - INTERVAL 14 DAY) WHERE rn = 1")
def _(e):
    return profiles.cached_latest(e.signals.where("kind = 'save'"), F.lit(AS_OF).cast("timestamp"), ["user_token", "object_id"]).select("user_token", "object_id", "event_id")


@query("prof_shortlist_signals", "SELECT user_token, object_id, min(kind) AS kind, epoch_us(max(ts)) AS last_us FROM signals WHERE kind IN ('click', 'save') GROUP BY 1, 2")
def _(e):
    out = profiles.shortlist_signals(e.signals.where("kind = 'save'"), e.signals.where("kind = 'click'"))
    return out.select("user_token", "object_id", "kind", F.unix_micros("last").alias("last_us"))


CELL = " UNION ALL ".join(f"SELECT object_id, category, '{a}' AS axis, {i} AS ax, {a} AS value FROM axes JOIN products USING (object_id)" for i, a in enumerate(vocab.AXES, 1))


@query("gen_axis_pairs", f"""WITH c AS ({CELL}), h0 AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY value DESC, object_id) AS t FROM c WHERE value >= 0.6), l0 AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY value, object_id) AS t FROM c WHERE value <= 0.4),
    h AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY md5(concat('s1|', axis, '|', object_id))) AS rn FROM h0 WHERE t <= 18), l AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY md5(concat('s1|', axis, '|', object_id))) AS rn FROM l0 WHERE t <= 18),
    p AS (SELECT h.category, h.axis, h.ax, h.rn, h.object_id AS high_id, l.object_id AS low_id, least(h.object_id, l.object_id) AS a, greatest(h.object_id, l.object_id) AS b FROM h JOIN l ON h.category = l.category AND h.axis = l.axis AND h.rn = l.rn WHERE h.rn <= 4 AND h.object_id <> l.object_id),
    d AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY category, ax, rn) AS k, md5(concat('s1|', a, '|', b)) AS lot FROM p), e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY lot) AS n FROM d WHERE k = 1)
    SELECT category, axis, high_id, low_id FROM e WHERE n <= 16 ORDER BY lot LIMIT 80""")
def _(e):
    return profiles.axis_pairs(e.axes, e.products, "s1")


def runs(e):
    """One curation run per user: kept = clicked or saved items, rejected = the other items seen."""
    return e.signals.groupBy(C("user_token").alias("run_id"), "object_id").agg(F.max(C("kind").isin("click", "save")).alias("kept"))


TRIPLETS = """rn AS (SELECT user_token AS run_id, object_id, bool_or(kind IN ('click', 'save')) AS kept FROM signals GROUP BY 1, 2),
    sz AS (SELECT run_id, least(2 * k, 4 * r, 40) AS n, least(k, 41) AS ku, least(r, 41) AS ru FROM (SELECT run_id, count(*) FILTER (kept) AS k, count(*) FILTER (NOT kept) AS r FROM rn GROUP BY 1) WHERE k >= 2 AND r >= 1),
    ka AS (SELECT run_id, object_id, row_number() OVER (PARTITION BY run_id ORDER BY md5(concat('s1a|', object_id)), object_id) AS s FROM rn WHERE kept), kn AS (SELECT run_id, object_id, row_number() OVER (PARTITION BY run_id ORDER BY md5(concat('s1n|', object_id)), object_id) AS s FROM rn WHERE NOT kept),
    dr AS (SELECT run_id, ku, ru, unnest(range(n)) AS i FROM sz),
    tri AS (SELECT dr.run_id, i, a.object_id AS anchor, p.object_id AS positive, n.object_id AS negative FROM dr JOIN ka a ON a.run_id = dr.run_id AND a.s = i % ku + 1 JOIN ka p ON p.run_id = dr.run_id AND p.s = (i + 1 + (i // ku) % (ku - 1)) % ku + 1
      JOIN kn n ON n.run_id = dr.run_id AND n.s = i % ru + 1)"""


@query("gen_triplets", f"WITH {TRIPLETS} SELECT * FROM tri")
def _(e):
    return training.triplets(runs(e), "s1")


def split_triplets(e):
    from modiste.operators.windows import train_split

    t = training.triplets(runs(e), "s1")
    return train_split(t, F.concat_ws("|", "run_id", C("i").cast("string")), "s2")


SPLIT = "sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat('s2|', run_id, '|', CAST(i AS VARCHAR))), concat(run_id, '|', CAST(i AS VARCHAR))) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM tri WHERE EXISTS (SELECT 1))"
TRAIN_EPOCHS, DIM = 3, 64


def training_sql() -> str:
    """Whole-batch steps, one table of matrix rows after the other, then the accuracy before and after."""
    parts = ["v AS MATERIALIZED (SELECT a.vec AS a, list_transform(list_zip(p.vec, n.vec), lambda x: x[1] - x[2]) AS d FROM sp JOIN units a ON a.object_id = anchor JOIN units p ON p.object_id = positive JOIN units n ON n.object_id = negative WHERE split = 'train')",
             f"w0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY j) AS r FROM (SELECT unnest(range(1, {DIM + 1})) AS i), (SELECT unnest(range(1, {DIM + 1})) AS j) GROUP BY i))"]
    for k in range(1, TRAIN_EPOCHS + 1):
        parts += [f"o{k} AS MATERIALIZED (SELECT * FROM (SELECT a, d, list_transform(m, lambda r: list_dot_product(r, a)) AS wa, list_transform(m, lambda r: list_dot_product(r, d)) AS wd FROM v, w{k - 1}) WHERE 0.2 - list_dot_product(wa, wd) > 0)",
                  f"c{k} AS MATERIALIZED (SELECT i, j, sum(wa[i] * d[j] + wd[i] * a[j]) AS g FROM o{k}, (SELECT unnest(range(1, {DIM + 1})) AS i), (SELECT unnest(range(1, {DIM + 1})) AS j) GROUP BY 1, 2)",
                  f"w{k} AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(x ORDER BY j) AS r FROM (SELECT c.i, c.j, m[c.i][c.j] + 0.5 / n * g AS x FROM c{k} c, w{k - 1}, (SELECT count(*) AS n FROM o{k})) GROUP BY i))"]
    said = "avg(CASE WHEN list_dot_product(list_transform(m, lambda r: list_dot_product(r, a.vec)), list_transform(m, lambda r: list_dot_product(r, p.vec))) > list_dot_product(list_transform(m, lambda r: list_dot_product(r, a.vec)), list_transform(m, lambda r: list_dot_product(r, n.vec))) THEN 1.0 ELSE 0.0 END)"
    tests = [f"SELECT '{name}' AS weights, round({said}, 3) AS accuracy, count(*) AS n FROM sp JOIN vectors a ON a.object_id = anchor JOIN vectors p ON p.object_id = positive JOIN vectors n ON n.object_id = negative, w{k} WHERE split = 'test'" for name, k in (("identity", 0), ("trained", TRAIN_EPOCHS))]
    return f"WITH {TRIPLETS}, {SPLIT}, {', '.join(parts)} {' UNION ALL '.join(tests)}"


@query("train_projection", training_sql())
def _(e):
    s = split_triplets(e)
    w, losses = training.train_projection(training.with_vectors(s.where("split = 'train'"), e.vectors), DIM, epochs=TRAIN_EPOCHS, batch_rows=1 << 40)
    test = s.where("split = 'test'")
    before, after = training.accuracy(test, e.vectors), training.accuracy(test, e.vectors, w)
    return before.select(F.lit("identity").alias("weights"), F.round("accuracy", 3).alias("accuracy"), "n").unionByName(after.select(F.lit("trained").alias("weights"), F.round("accuracy", 3).alias("accuracy"), "n"))


STEP_ROWS = 4


@query("train_step", f"""WITH {TRIPLETS}, {SPLIT}, v AS (SELECT a.vec AS a, list_transform(list_zip(p.vec, n.vec), lambda x: x[1] - x[2]) AS d FROM sp JOIN units a ON a.object_id = anchor JOIN units p ON p.object_id = positive JOIN units n ON n.object_id = negative WHERE split = 'train'),
    h AS (SELECT a, d, 0.2 - list_dot_product(a, d) AS hinge FROM v), o AS (SELECT * FROM h WHERE hinge > 0), s AS (SELECT sum(hinge) / count(*) AS loss, count(*) AS n FROM o),
    c AS (SELECT i, j, sum(a[i + 1] * d[j + 1] + d[i + 1] * a[j + 1]) AS g FROM o, (SELECT unnest(range({STEP_ROWS})) AS i), (SELECT unnest(range(64)) AS j) GROUP BY 1, 2)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN i = j THEN 1.0 ELSE 0.0 END + 0.5 / n * g, 6) + 0.0 AS w, round(loss, 6) AS loss FROM c, s""")
def _(e):
    rows = split_triplets(e).where("split = 'train'")
    w, losses = training.train_projection(training.with_vectors(rows, e.vectors), 64, epochs=1, batch_rows=1 << 40)
    return e.spark.createDataFrame([(i, j, float(w[i, j]), losses[0]) for i in range(STEP_ROWS) for j in range(64)], "i int, j int, w double, loss double").select("i", "j", (F.round("w", 6) + 0.0).alias("w"), F.round("loss", 6).alias("loss"))


ACC = "avg(CASE WHEN list_dot_product(list_transform(a.vec, lambda x, j: x * (1 + {f} * j)), list_transform(p.vec, lambda x, j: x * (1 + {f} * j))) > list_dot_product(list_transform(a.vec, lambda x, j: x * (1 + {f} * j)), list_transform(n.vec, lambda x, j: x * (1 + {f} * j))) THEN 1.0 ELSE 0.0 END)"


@query("train_promote", f"""WITH {TRIPLETS}, {SPLIT}, c AS (SELECT {ACC.format(f='0.0')} AS previous, {ACC.format(f='0.02')} AS candidate FROM sp JOIN units a ON a.object_id = anchor JOIN units p ON p.object_id = positive JOIN units n ON n.object_id = negative WHERE split = 'test')
    SELECT round(previous, 6) AS previous, round(candidate, 6) AS candidate, candidate >= previous + 0.01 AS promoted FROM c""")
def _(e):
    import numpy as np

    test = split_triplets(e).where("split = 'test'")
    w = np.diag([1 + 0.02 * (j + 1) for j in range(64)])
    units = e.vectors.withColumn("vec", vec.normalize(C("vec")))
    out = training.promote(training.accuracy(test, units), training.accuracy(test, units, w))
    return out.select(F.round("previous", 6).alias("previous"), F.round("candidate", 6).alias("candidate"), "promoted")


@query("eval_sets", """WITH r AS (SELECT l AS label, object_id, l IN (category, tag, color) AS kept FROM products, (VALUES ('dress'), ('edgy'), ('mini'), ('red'), ('unused')) x(l) WHERE NOT (tag = '' AND color = ''))
    SELECT label, object_id, kept FROM r WHERE label IN (SELECT label FROM r GROUP BY 1 HAVING count(*) FILTER (kept) >= 20)""")
def _(e):
    items = e.products.where("NOT (tag = '' AND color = '')").select("object_id", F.filter(F.array("category", "tag", "color"), lambda x: x != "").alias("labels"))
    return training.evaluation_sets(items, ["dress", "edgy", "mini", "red", "unused"])
