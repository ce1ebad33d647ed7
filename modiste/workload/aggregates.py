"""Registered queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import aggregates
from modiste.workload.fixtures import AS_OF, query, quoted, r6, r6c
from modiste.workload.filters import ALLOW, BLOCK, ALLOW_SQL

C = F.col


def long_vec(df, *keys):
    """One row per vector entry, so that values compare one by one."""
    return df.select(*keys, F.posexplode("vec").alias("i", "x")).select(*keys, C("i").cast("long").alias("i"), r6c(C("x")).alias("x"))


MEAN = """SELECT {keys}, i, avg(x) AS m, count(*) AS n FROM (SELECT {keys}, unnest(vec) AS x, unnest(range(64)) AS i FROM {src}) GROUP BY {keys}, i"""
UNIT = "SELECT {keys}, CAST(i AS BIGINT) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY {keys})), 6) + 0.0 AS x FROM {src}"


def unit_mean(src: str, keys: str) -> str:
    return UNIT.format(keys=keys, src="(" + MEAN.format(keys=keys, src=src) + ")")


def wmean(src: str, keys: str) -> str:
    """Weighted mean entries of rows (keys, vec, w)."""
    return f"SELECT {keys}, i, sum(x * w) / sum(w) AS m FROM (SELECT {keys}, w, unnest(vec) AS x, unnest(range(64)) AS i FROM {src}) GROUP BY {keys}, i"


def unit_wmean(src: str, keys: str) -> str:
    return UNIT.format(keys=keys, src="(" + wmean(src, keys) + ")")


@query("agg_facet_counts", " UNION ALL ".join(f"SELECT '{f}' AS facet, value, n FROM (SELECT {f} AS value, count(*) AS n FROM products WHERE {f} <> '' GROUP BY {f} ORDER BY n DESC, value LIMIT 1000)" for f in ("brand", "category", "color", "price_range")))
def _(e):
    return aggregates.facet_counts(e.products, ["brand", "category", "color", "price_range"], max_values=1000)


GOOD = "starts_with(image_url, 'http') AND NOT contains(image_url, 'placeholder')"


@query("agg_brand_directory", f"""WITH p AS (SELECT *, CASE WHEN size > 25 THEN retailer ELSE brand END AS b FROM products),
    k AS (SELECT retailer AS name, 0 AS o, pos, image_url FROM p UNION ALL SELECT b, 1, pos, image_url FROM p)
    SELECT name, CASE WHEN min(o) = 0 THEN count(*) FILTER (o = 0) ELSE count(*) FILTER (o = 1) END AS n, min_by(image_url, pos) FILTER ({GOOD}) AS image FROM k WHERE name <> 'r-2' GROUP BY name""")
def _(e):
    p = e.products.withColumn("brand", F.when(C("size") > 25, C("retailer")).otherwise(C("brand")))
    return aggregates.brand_directory(p, skip=["r-2"])


@query("agg_brand_best_image", r"""SELECT name, count(*) AS n, arg_max(image_url, CAST(s AS BIGINT) * 1000000000 - pos) FILTER (s > 0) AS image FROM (SELECT coalesce(nullif(CASE WHEN size > 25 THEN '' ELSE retailer END, ''), brand) AS name, pos, image_url,
      CASE WHEN NOT coalesce(starts_with(image_url, 'http'), false) THEN 0 WHEN category IN ('dress', 'top') AND NOT regexp_matches(title, '\b(rod|ring)\b') THEN 3 WHEN NOT regexp_matches(title, '\b(rod|ring)\b') THEN 2 ELSE 1 END AS s FROM products) GROUP BY name""")
def _(e):
    p = e.products.withColumn("retailer", F.when(C("size") > 25, "").otherwise(C("retailer")))
    return aggregates.brand_best_image(p, r"\b(rod|ring)\b", ["dress", "top"])


@query("agg_category_index", f"SELECT category, count(*) AS n, min_by(image_url, pos) FILTER (starts_with(image_url, 'http') AND {ALLOW_SQL}) AS image FROM products GROUP BY category")
def _(e):
    return aggregates.category_index(e.products, ALLOW, BLOCK)


@query("agg_breakdowns", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {x} AS value FROM products" for d, x in (
    ("category", "category"), ("retailer", "retailer"), ("price_range", "price_range"), ("image_host", "split_part(image_url, '/', 3)"), ("price_known", "CASE WHEN price IS NOT NULL THEN 'yes' END")))
    + ") SELECT dimension, value, count(*) AS n, round(sum(count(*)) FILTER (value IS NULL) OVER (PARTITION BY dimension) / sum(count(*)) OVER (PARTITION BY dimension), 6) AS null_rate FROM u GROUP BY 1, 2")
def _(e):
    dims = {"category": C("category"), "retailer": C("retailer"), "price_range": C("price_range"), "image_host": F.split_part("image_url", F.lit("/"), F.lit(3)),
            "price_known": F.when(C("price").isNotNull(), "yes")}
    b = aggregates.breakdowns(e.products, dims)
    return b.select("dimension", "value", "n", F.when(C("null_rate") > 0, F.round("null_rate", 6)).alias("null_rate"))


CENT = """m AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY object_id) AS rn FROM (SELECT brand, object_id, vec FROM units JOIN products USING (object_id))), c AS (SELECT * FROM m WHERE rn <= 20)"""


@query("agg_centroid", f"WITH {CENT}, k AS (SELECT brand, count(*) AS n FROM c GROUP BY brand) SELECT u.*, k.n FROM ({unit_mean('c', 'brand')}) u JOIN k USING (brand)")
def _(e):
    m = e.vectors.join(e.products.select("object_id", "brand"), "object_id").select("brand", "object_id", "vec")
    return long_vec(aggregates.centroid(m, ["brand"], cap=20), "brand", "n")


WSIG = """w AS (SELECT user_token, kind, object_id, (CASE kind WHEN 'save' THEN 2.0 ELSE 1.0 END) * pow(0.85, row_number() OVER (PARTITION BY user_token, kind ORDER BY ts DESC, event_id DESC) - 1) AS w
    FROM signals WHERE kind IN ('save', 'like'))"""


@query("agg_weighted_centroid", f"WITH {WSIG}, j AS (SELECT user_token, w, vec FROM w JOIN vectors USING (object_id)) {unit_wmean('j', 'user_token')}")
def _(e):
    w = aggregates.signal_weights(e.signals, {"save": 2.0, "like": 1.0})
    return long_vec(aggregates.weighted_centroid(w, e.vectors, ["user_token"]), "user_token")


@query("agg_axis_profile", f"""WITH {WSIG} SELECT user_token, {", ".join(f"round(sum(w * {a}) / sum(w) FILTER ({a} IS NOT NULL), 6) AS {a}" for a in vocab.AXES)}
    FROM w JOIN (SELECT object_id, {", ".join(f"CASE WHEN {a} > 0.2 THEN {a} END AS {a}" for a in vocab.AXES)} FROM axes) USING (object_id) GROUP BY user_token""")
def _(e):
    w = aggregates.signal_weights(e.signals, {"save": 2.0, "like": 1.0})
    axes = e.axes.select("object_id", *[F.when(C(a) > 0.2, C(a)).alias(a) for a in vocab.AXES])
    return aggregates.axis_profile(w, axes, ["user_token"]).select("user_token", *[F.round(a, 6).alias(a) for a in vocab.AXES])


def clicks(e):
    return e.signals.where("kind = 'click'").join(e.products.select("object_id", "brand", "color", "retailer", "category"), "object_id")


FEATURES = f"""k AS (SELECT user_token, exp(-ln(2.0) * greatest(0.0, (epoch_us(TIMESTAMP {quoted(AS_OF)}) - epoch_us(ts)) / 86400e6) / 30) AS w, brand, color, retailer FROM signals JOIN products USING (object_id) WHERE kind = 'click'),
    features AS (SELECT user_token, feature, trim(lower(value)) AS value, sum(w) AS weight FROM (SELECT user_token, w, 'brand' AS feature, brand AS value FROM k UNION ALL SELECT user_token, w, 'color', color FROM k
      UNION ALL SELECT user_token, w, 'retailer', retailer FROM k) WHERE value <> '' GROUP BY 1, 2, 3)"""


def features(e):
    return aggregates.click_affinity_features(clicks(e), F.lit(AS_OF).cast("timestamp"))


@query("agg_click_affinity_features", f"WITH {FEATURES} SELECT user_token, feature, value, round(weight, 6) AS weight FROM features")
def _(e):
    return features(e).withColumn("weight", F.round("weight", 6))


BIAS = """b AS (SELECT s.user_token, s.ts, CASE WHEN kind = 'dislike' THEN 'disliked' ELSE 'liked' END AS side, p.* FROM signals s JOIN products p USING (object_id) WHERE kind IN ('click', 'save', 'dislike')),
    u AS (SELECT user_token, ts, side, 'brand' AS feature, brand AS value FROM b UNION ALL SELECT user_token, ts, side, 'category', category FROM b UNION ALL SELECT user_token, ts, side, 'color', color FROM b),
    c AS (SELECT user_token, side, feature, value, count(*) AS n, max(ts) AS last FROM u WHERE value <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_token, side, feature ORDER BY n DESC, last DESC, value) AS rn FROM c)"""


@query("agg_bias_topn", f"""WITH {BIAS} SELECT user_token, side, feature, value, n FROM r WHERE (side = 'liked' AND rn <= CASE feature WHEN 'brand' THEN 5 WHEN 'category' THEN 4 ELSE 3 END)
    OR (side = 'disliked' AND ((feature = 'brand' AND n >= 2) OR (feature = 'category' AND n >= 3)))""")
def _(e):
    s = e.signals.join(e.products.select("object_id", "brand", "category", "color"), "object_id")
    return aggregates.bias_topn(s)


IGNORED = """x AS (SELECT user_token, object_id FROM signals GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN kind = 'impression' THEN session_id END) >= 2 AND count(*) FILTER (kind = 'click') = 0),
    i AS (SELECT user_token, lower(color) AS color, brand, category FROM x JOIN products USING (object_id)), n AS (SELECT user_token, count(*) AS na FROM i GROUP BY 1)"""


@query("agg_soft_avoids", f"""WITH {IGNORED}, u AS (SELECT user_token, 'color' AS f, color AS v FROM i UNION ALL SELECT user_token, 'brand', brand FROM i UNION ALL SELECT user_token, 'category', category FROM i)
    SELECT user_token, concat(v, CASE f WHEN 'color' THEN ' colors' WHEN 'brand' THEN ' brand' ELSE ' styles' END) AS avoid, count(*) AS n FROM u JOIN n USING (user_token) WHERE v <> '' AND NOT (f = 'color' AND v = 'unknown')
    GROUP BY user_token, f, v, na HAVING count(*) >= CASE WHEN f = 'category' THEN floor(na * 0.5) ELSE greatest(2, floor(na * 0.3)) END""")
def _(e):
    return aggregates.soft_avoids(e.signals, e.products)


@query("agg_implicit_avoids", """WITH d AS (SELECT s.user_token, s.ts, s.event_id, p.category, p.color, p.tag FROM signals s JOIN products p USING (object_id) WHERE kind = 'dislike'),
    n AS (SELECT user_token, count(*) AS na FROM d GROUP BY 1 HAVING count(*) >= 3),
    t AS (SELECT user_token, ts, event_id, 0 AS slot, category AS term FROM d UNION ALL SELECT user_token, ts, event_id, 1, color FROM d UNION ALL SELECT user_token, ts, event_id, 2, tag FROM d),
    c AS (SELECT user_token, term, count(*) AS n, min(struct_pack(a := -epoch_us(ts), b := -event_id, c := slot)) AS f FROM t WHERE length(term) > 2 GROUP BY 1, 2),
    r AS (SELECT user_token, term, n, row_number() OVER (PARTITION BY user_token ORDER BY f, term) AS rn FROM c JOIN n x USING (user_token) WHERE n >= greatest(3, floor(na * 0.2)))
    SELECT user_token, term, n FROM r WHERE rn <= 5""")
def _(e):
    d = e.signals.where("kind = 'dislike'").join(e.tagged.select("object_id", "category", "color", "aesthetic_tags"), "object_id")
    return aggregates.implicit_avoids(d, share=0.2)


ENGAGED = """SELECT user_token, session_id, avg(CASE WHEN dwell_ms <= 500 THEN 0.0 WHEN dwell_ms >= 8000 THEN 1.0 ELSE ln(dwell_ms / 500) / ln(16.0) END) AS m, count(*) AS n, count(*) FILTER (kind = 'like') AS l, count(*) FILTER (kind = 'dislike') AS d
    FROM signals GROUP BY 1, 2"""


@query("agg_session_engagement", f"""SELECT user_token, session_id, round(m, 6) AS mean_dwell, round(0.70 + 0.65 * m, 6) AS multiplier, round(CASE WHEN n < 3 THEN 0.75 ELSE least(0.75, greatest(0.15, 0.75 - (0.60 * m + 0.25 * l / n - 0.35 * least(1.0, d / n)))) END, 6) AS explore
    FROM ({ENGAGED})""")
def _(e):
    return aggregates.session_engagement(e.signals).select("user_token", "session_id", *[F.round(c, 6).alias(c) for c in ("mean_dwell", "multiplier", "explore")])


@query("agg_trend_relevance", """WITH t0 AS (SELECT title AS keyword, round(avg(size), 6) AS mom FROM products GROUP BY title ORDER BY round(avg(size), 6) DESC, title LIMIT 50),
    t AS (SELECT *, row_number() OVER (ORDER BY mom DESC, keyword) AS ord FROM t0),
    s AS (SELECT object_id, keyword, ord, len(list_filter(string_split(keyword, ' '), lambda w: length(w) > 3 AND contains(lower(description), w))) AS score FROM products, t),
    r AS (SELECT *, max(score) OVER (PARTITION BY object_id) AS best, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, ord) AS rank FROM s)
    SELECT object_id, rank, keyword, score FROM r WHERE (best > 0 AND score > 0 AND rank <= 6) OR (best = 0 AND rank <= 3)""")
def _(e):
    trends = e.products.groupBy(C("title").alias("keyword")).agg(F.round(F.avg("size"), 6).alias("mom"))
    return aggregates.trend_relevance(e.products, trends, C("description"), ["object_id"])


@query("agg_label_progress", "SELECT label, count(*) AS n, count(*) < 100 AS below_minimum, count(*) >= 250 AS done FROM (SELECT unnest([category, tag, color]) AS label FROM products) WHERE label <> '' GROUP BY label")
def _(e):
    items = e.products.select(F.filter(F.array("category", "tag", "color"), lambda x: x != "").alias("labels"))
    return aggregates.label_progress(items, 100, 250)


TRIPLES = """t AS (SELECT a.object_id AS anchor, b.object_id AS positive, c.object_id AS negative FROM (SELECT vec_id, object_id FROM vectors) a JOIN (SELECT vec_id, object_id FROM vectors) b ON b.vec_id = a.vec_id + 10
    JOIN (SELECT vec_id, object_id FROM vectors) c ON c.vec_id = a.vec_id + 17)"""


@query("agg_triplet_accuracy", f"""WITH {TRIPLES} SELECT round(avg(CASE WHEN list_dot_product(a.vec, p.vec) > list_dot_product(a.vec, n.vec) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
    FROM t JOIN vectors a ON a.object_id = anchor JOIN vectors p ON p.object_id = positive JOIN vectors n ON n.object_id = negative""")
def _(e):
    ids = e.vectors.select("vec_id", C("object_id"))
    t = (ids.select("vec_id", C("object_id").alias("anchor")).join(ids.select((C("vec_id") - 10).alias("vec_id"), C("object_id").alias("positive")), "vec_id")
         .join(ids.select((C("vec_id") - 17).alias("vec_id"), C("object_id").alias("negative")), "vec_id"))
    return aggregates.triplet_accuracy(t, e.vectors).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query("agg_leak_rate", """WITH r AS (SELECT q.query_id, p.category, p.title, row_number() OVER (PARTITION BY q.query_id, p.category ORDER BY price DESC NULLS LAST, p.object_id) AS rank
      FROM queries q JOIN products p ON split_part(p.title, ' ', 1) = split_part(q.text, ' ', 1))
    SELECT query_id, r.category, count(*) FILTER (contains(title, 'rod') OR contains(title, split_part(text, ' ', 2))) AS leaks, count(*) AS shown FROM r JOIN queries USING (query_id) WHERE rank <= 6 GROUP BY 1, 2""")
def _(e):
    from modiste.scale import first_k

    q = e.queries.select("query_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("w"))
    p = e.products.withColumn("w", F.split_part("title", F.lit(" "), F.lit(1)))
    r = q.join(first_k(p, ["w", "category"], [C("price").desc_nulls_last(), "object_id"], 6, "rank"), "w")
    briefs = e.queries.select("query_id", F.array(F.lit("rod"), F.split_part("text", F.lit(" "), F.lit(2))).alias("anti_leak"))
    return aggregates.leak_rate(r, briefs)
