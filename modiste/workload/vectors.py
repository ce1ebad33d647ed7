"""Registered queries of the vector operators. Vectors are compared entry by entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste.functions import vec
from modiste.operators import vectors as ops
from modiste.plans.profiles import style_inference
from modiste.workload.aggregates import long_vec, unit_mean, unit_wmean
from modiste.workload.fixtures import query, r6c

C = F.col


def unit_rows(src: str, key: str) -> str:
    """Unit vectors of rows (key, i, m), entry by entry."""
    return f"SELECT {key}, CAST(i AS BIGINT) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY {key})), 6) + 0.0 AS x FROM {src}"


ENTRIES = "en AS (SELECT object_id, label, unnest(vec) AS x, unnest(range(64)) AS i FROM vectors), un AS (SELECT object_id, label, unnest(vec) AS x, unnest(range(64)) AS i FROM units)"
LABEL_MEAN = "lm AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM (SELECT label, i, avg(x) AS m FROM en GROUP BY 1, 2))"


@query("vec_dot_norm_cosine", "SELECT object_id, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS dot, round(sqrt(list_dot_product(a.vec, a.vec)), 6) AS norm, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS cosine FROM vectors a JOIN vibes b USING (object_id)")
def _(e):
    j = e.vectors.select("object_id", C("vec").alias("a")).join(e.vibes.select("object_id", C("vec").alias("b")), "object_id")
    return j.select("object_id", r6c(vec.dot(C("a"), C("b"))).alias("dot"), F.round(vec.norm(C("a")), 6).alias("norm"), r6c(vec.cosine(C("a"), C("b"))).alias("cosine"))


@query("vec_normalize", f"WITH {ENTRIES} {unit_rows('(SELECT object_id, i, x * 3 AS m FROM en)', 'object_id')}")
def _(e):
    return long_vec(e.vectors.select("object_id", vec.normalize(vec.scale(C("vec"), 3.0)).alias("vec")), "object_id")


@query("vec_mean", "SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 6) + 0.0 AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS i FROM vectors) GROUP BY 1, 2")
def _(e):
    return long_vec(vec.mean_by(e.vectors, ["label"], unit=False), "label")


def with_label_mean(e):
    return e.vectors.join(vec.mean_by(e.vectors, ["label"], unit=False, out="mean"), "label")


@query("vec_blend", f"WITH {ENTRIES}, {LABEL_MEAN} {unit_rows('(SELECT object_id, i, 0.7 * x + 0.3 * lm.m AS m FROM en JOIN lm USING (label, i))', 'object_id')}")
def _(e):
    return long_vec(with_label_mean(e).select("object_id", vec.blend(C("vec"), C("mean"), 0.3).alias("vec")), "object_id")


@query("vec_subtract", f"WITH {ENTRIES}, {LABEL_MEAN} {unit_rows('(SELECT object_id, i, x - 0.25 * lm.m AS m FROM en JOIN lm USING (label, i))', 'object_id')}")
def _(e):
    return long_vec(with_label_mean(e).select("object_id", vec.subtract(C("vec"), C("mean"), 0.25).alias("vec")), "object_id")


@query("vec_image_text_blend", f"""WITH {ENTRIES}, t AS (SELECT label, i, max(x) AS x FROM en GROUP BY 1, 2), {LABEL_MEAN} {unit_rows('(SELECT label, i, 0.7 * lm.m + 0.3 * t.x AS m FROM lm JOIN t USING (label, i))', 'label')}""")
def _(e):
    texts = e.vectors.groupBy("label").agg(*[F.max(F.get("vec", F.lit(i))).alias(f"m{i}") for i in range(64)]).select("label", F.array(*[f"m{i}" for i in range(64)]).alias("vec"))
    return long_vec(ops.image_text_blend(e.vectors, texts, ["label"]), "label")


@query("vec_weighted_combine", "WITH p AS (SELECT object_id, vec, 1.0 AS w FROM units UNION ALL SELECT object_id, list_reverse(vec), 0.5 FROM units WHERE label < 5) " + unit_wmean("p", "object_id"))
def _(e):
    parts = e.vectors.select("object_id", "vec", F.lit(1.0).alias("w")).unionByName(e.vibes.select("object_id", "vec", F.lit(0.5).alias("w")))
    return long_vec(ops.weighted_combine(parts, ["object_id"]), "object_id")


def leader_sql(steps: int, threshold: float) -> str:
    """The leader walk over a query's vectors, step by step: sums of the clusters and their sizes."""
    parts = ["v AS (SELECT query_id, list(vec ORDER BY phrase) AS vs FROM (SELECT query_id, phrase, vec FROM phrases UNION ALL SELECT query_id, 0, vec FROM queries) GROUP BY 1)",
             "w1 AS (SELECT query_id, vs, [vs[1]] AS sums, [1] AS n FROM v)"]
    for k in range(2, steps + 1):
        parts.append(f"s{k} AS (SELECT *, list_transform(sums, lambda s: CASE WHEN list_dot_product(s, s) = 0 OR list_dot_product(vs[{k}], vs[{k}]) = 0 THEN 0.0 ELSE list_cosine_similarity(s, vs[{k}]) END) AS sims FROM w{k - 1})")
        parts.append(f"b{k} AS (SELECT *, list_max(sims) AS top, list_position(sims, list_max(sims)) AS i FROM s{k})")
        parts.append(f"""w{k} AS (SELECT query_id, vs, CASE WHEN len(vs) < {k} THEN sums WHEN top > {threshold} THEN list_transform(sums, lambda s, j: CASE WHEN j = i THEN list_transform(list_zip(s, vs[{k}]), lambda p: p[1] + p[2]) ELSE s END) ELSE list_append(sums, vs[{k}]) END AS sums,
            CASE WHEN len(vs) < {k} THEN n WHEN top > {threshold} THEN list_transform(n, lambda c, j: CASE WHEN j = i THEN c + 1 ELSE c END) ELSE list_append(n, 1) END AS n FROM b{k})""")
    return f"""WITH {', '.join(parts)}, u AS (SELECT query_id, len(vs) AS total, unnest(sums) AS s, unnest(n) AS size, generate_subscripts(n, 1) AS age FROM w{steps})
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY size DESC, age) - 1 AS INTEGER) AS cluster, size / total AS weight, CAST(size AS BIGINT) AS size,
        round(CASE WHEN total = 1 THEN s[1] ELSE s[1] / sqrt(list_dot_product(s, s)) END, 6) AS v0 FROM u"""


@query("vec_greedy_cluster", leader_sql(5, 0.25))
def _(e):
    return ops.greedy_cluster(e.phrases.unionByName(e.queries.select("query_id", F.lit(0).alias("phrase"), "vec")), "query_id", ["phrase"], 0.25).select(
        "query_id", "cluster", "weight", "size", F.round(F.get("vec", F.lit(0)), 6).alias("v0"))


TIERS = """tr AS (SELECT query_id, CASE WHEN phrase <= 2 THEN 1 ELSE 3 END AS tier, CASE WHEN phrase <= 2 THEN phrase - 1 ELSE phrase - 3 END AS ord, CASE WHEN avoid = '' OR phrase > 2 THEN p.vec END AS vec FROM phrases p JOIN queries q USING (query_id)),
    tf AS (SELECT query_id, min(tier) AS tier FROM tr WHERE vec IS NOT NULL GROUP BY 1), tk AS (SELECT query_id, vec FROM tr JOIN tf USING (query_id, tier) WHERE vec IS NOT NULL)"""


def tiers(e):
    p = e.phrases.join(e.queries.select("query_id", "avoid"), "query_id")
    low = C("phrase") <= 2
    return p.select("query_id", F.when(low, 1).otherwise(3).alias("tier"), F.when(low, C("phrase") - 1).otherwise(C("phrase") - 3).alias("ord"),
                    F.when((C("avoid") == "") | ~low, C("vec")).alias("vec"))


@query("vec_ensemble_query", f"WITH {TIERS} {unit_mean('tk', 'query_id')}")
def _(e):
    out = ops.ensemble_query(tiers(e))
    return long_vec(out.withColumn("vec", vec.normalize(C("vec"))), "query_id")


@query("vec_anchor_images", f"""WITH pe AS (SELECT query_id, phrase, unnest(vec) AS x, unnest(range(64)) AS i FROM phrases), a AS (SELECT query_id, i, avg(x) AS m FROM pe WHERE phrase <= 2 GROUP BY 1, 2), n AS (SELECT query_id, i, avg(x) AS m FROM pe WHERE phrase > 2 GROUP BY 1, 2),
    au AS (SELECT query_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY query_id)) AS m FROM a), nu AS (SELECT query_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY query_id)) AS m FROM n),
    q AS (SELECT query_id, unnest(vec) AS x, unnest(range(64)) AS i FROM queries), b AS (SELECT query_id, i, 0.9 * x + 0.1 * m AS y FROM q JOIN au USING (query_id, i)),
    bu AS (SELECT query_id, i, y / sqrt(sum(y * y) OVER (PARTITION BY query_id)) AS y FROM b) {unit_rows('(SELECT query_id, i, y - 0.125 * m AS m FROM bu JOIN nu USING (query_id, i))', 'query_id')}""")
def _(e):
    return long_vec(ops.anchor_images(e.queries.select("query_id", "vec"), e.phrases.where("phrase <= 2"), e.phrases.where("phrase > 2")), "query_id")


W = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(64)]


@query("vec_project", f"""WITH {ENTRIES}, p AS (SELECT object_id, r.i AS i, sum(CAST((r.i * 7 + en.i * 3) % 11 - 5 AS DOUBLE) / 10 * x) AS m FROM en, range(64) r(i) GROUP BY 1, 2) {unit_rows('p', 'object_id')}""")
def _(e):
    return long_vec(e.vectors.select("object_id", vec.project(C("vec"), W).alias("vec")), "object_id")


STYLES = "st AS (SELECT label, list(x ORDER BY i) AS vec FROM (" + unit_mean("units", "label").replace("round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) + 0.0", "m / sqrt(sum(m * m) OVER (PARTITION BY label))") + ") GROUP BY label)"
INFER = """sc AS (SELECT query_id, label, s.vec AS vec, round(list_cosine_similarity(q.vec, s.vec), 6) + 0.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.vec, s.vec), 6) + 0.0 DESC, CAST(label AS VARCHAR)) AS rn FROM queries q, st s),
    ip AS (SELECT query_id, vec, w FROM sc WHERE rn <= 2 AND w > 0)"""


def styles(e):
    units = e.vectors.withColumn("vec", vec.normalize(C("vec")))
    return vec.mean_by(units, ["label"]).select(C("label").cast("string").alias("style"), "vec")


@query("vec_style_inference", f"WITH {STYLES}, {INFER} {unit_wmean('ip', 'query_id')}")
def _(e):
    return long_vec(style_inference(e.queries.select("query_id", "vec"), styles(e), key="query_id"), "query_id")


@query("vec_health", """SELECT label, count(*) AS n, CAST(min(len(vec)) AS BIGINT) AS min_dim, CAST(max(len(vec)) AS BIGINT) AS max_dim, round(avg(sqrt(list_dot_product(vec, vec))), 6) AS mean_norm, count(*) FILTER (abs(sqrt(list_dot_product(vec, vec)) - 1) > 0.01) AS bad_norm,
    count(*) FILTER (vec IS NULL) AS missing FROM (SELECT label, CASE WHEN vec[1] > 0.2 THEN list_transform(vec, lambda x: x * 1.5) ELSE vec END AS vec FROM vectors) GROUP BY label""")
def _(e):
    v = e.vectors.select("label", F.when(F.get("vec", F.lit(0)) > 0.2, vec.scale(C("vec"), 1.5)).otherwise(C("vec")).alias("vec"))
    return ops.health(v, ["label"]).withColumn("mean_norm", F.round("mean_norm", 6))


@query("vec_distinctness", """SELECT concat('p-', CAST(a.vec_id AS VARCHAR)) AS a, concat('p-', CAST(b.vec_id AS VARCHAR)) AS b, score FROM (SELECT a.vec_id AS ai, b.vec_id AS bi, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM vectors a JOIN vectors b ON concat('p-', CAST(a.vec_id AS VARCHAR)) < concat('p-', CAST(b.vec_id AS VARCHAR)))
    JOIN vectors a ON a.vec_id = ai JOIN vectors b ON b.vec_id = bi WHERE score >= 0.4""")
def _(e):
    return ops.too_similar(e.vectors.select(C("object_id").alias("probe"), "vec"), limit=0.4)
