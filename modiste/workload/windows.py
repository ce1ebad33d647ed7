"""Registered queries of the window operators. Most run on one ranked list per (query): the catalogue rows that share the query's first word."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import windows
from modiste.scale import first_k
from modiste.workload.fixtures import query, r6c
from modiste.workload.scalars import in_list

C = F.col

LISTS = """lists AS (SELECT category AS lane, row_number() OVER (PARTITION BY category ORDER BY price DESC NULLS LAST, object_id) AS lpos, p.* FROM products p)"""


def lists(e):
    """Each category's catalogue as one ranked list: (lane, lpos, product columns)."""
    from modiste.scale import numbered

    return numbered(e.tagged.withColumn("lane", C("category")), ["lane"], [C("price").desc_nulls_last(), "object_id"], "lpos")


POOL = "pool AS (SELECT brand, category, object_id, CASE WHEN size > 10 THEN round(edge, 9) END AS score FROM products JOIN axes USING (object_id))"


def pool(e):
    return e.products.join(e.axes, "object_id").select("brand", "category", "object_id", F.when(C("size") > 10, F.round("edge", 9)).alias("score"))


@query("win_znorm", f"WITH {POOL} SELECT object_id, round(CASE WHEN score IS NULL OR stddev_pop(score) OVER w < 1e-9 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) + 0.0 AS z FROM pool WINDOW w AS (PARTITION BY category)")
def _(e):
    return windows.znorm(pool(e), ["category"], "score", "z").select("object_id", r6c(C("z")).alias("z"))


RN = """rnk AS (SELECT *, count(score) OVER (PARTITION BY {k}) AS n, row_number() OVER (PARTITION BY {k} ORDER BY score NULLS LAST, object_id) AS rk FROM pool)"""


@query("win_ranknorm", f"WITH {POOL}, {RN.format(k='brand')} SELECT object_id, round(CASE WHEN score IS NULL THEN 0.0 WHEN n = 1 THEN 1.0 ELSE (rk - 1) / (n - 1) END, 6) AS r FROM rnk")
def _(e):
    return windows.ranknorm(pool(e), ["brand"], "score", "r", ["object_id"]).select("object_id", F.round("r", 6).alias("r"))


@query("win_adaptive_norm", f"""WITH {POOL}, x AS (SELECT *, count(score) OVER (PARTITION BY brand) AS n, row_number() OVER (PARTITION BY brand ORDER BY score NULLS LAST, object_id) AS rk,
      avg(score) OVER (PARTITION BY brand) AS m, stddev_pop(score) OVER (PARTITION BY brand) AS sd FROM pool)
    SELECT object_id, round(CASE WHEN score IS NULL THEN 0.0 WHEN n >= 16 THEN CASE WHEN sd < 1e-9 THEN 0.0 ELSE (score - m) / sd END WHEN n = 1 THEN 1.0 ELSE (rk - 1) / (n - 1) END, 6) + 0.0 AS v FROM x""")
def _(e):
    return windows.adaptive_norm(pool(e), ["brand"], "score", "v", ["object_id"], min_pool=16).select("object_id", r6c(C("v")).alias("v"))


@query("win_first_per_key", "SELECT object_id FROM (SELECT object_id, row_number() OVER (PARTITION BY retailer, title ORDER BY pos) AS rn FROM products) WHERE rn = 1")
def _(e):
    from modiste.scale import first_per_key

    return first_per_key(e.products, ["retailer", "title"], ["pos"]).select("object_id")


@query("win_cap_per_group", f"""WITH {LISTS}, a AS (SELECT *, row_number() OVER (PARTITION BY lane, retailer ORDER BY lpos) AS r1 FROM lists), b AS (SELECT *, row_number() OVER (PARTITION BY lane, brand ORDER BY lpos) AS r2 FROM a WHERE r1 <= 10)
    SELECT lane, object_id FROM b WHERE r2 <= 3""")
def _(e):
    return windows.cap_per_group(lists(e), [(["lane", "retailer"], 10), (["lane", "brand"], 3)], ["lpos"]).select("lane", "object_id")


@query("win_global_first_category", """WITH r AS (SELECT user_token, object_id, CASE WHEN kind = 'click' THEN 'top' WHEN kind = 'save' THEN 'dress' WHEN kind = 'like' THEN 'bag' ELSE 'shoes' END AS category, event_id FROM signals),
    f AS (SELECT user_token, object_id, category, event_id, row_number() OVER (PARTITION BY user_token, object_id ORDER BY CASE category WHEN 'dress' THEN 1 WHEN 'top' THEN 2 WHEN 'shoes' THEN 5 ELSE 6 END, event_id) AS rn FROM r)
    SELECT user_token, object_id, category, event_id FROM f WHERE rn = 1""")
def _(e):
    cat = F.when(C("kind") == "click", "top").when(C("kind") == "save", "dress").when(C("kind") == "like", "bag").otherwise("shoes")
    return windows.global_first_category(e.signals.withColumn("category", cat), ["user_token"], order=["event_id"]).select("user_token", "object_id", "category", "event_id")


RR = """x AS (SELECT *, row_number() OVER (PARTITION BY lane, {b} ORDER BY lpos) AS rn, min(lpos) OVER (PARTITION BY lane, {b}) AS f FROM lists)"""


@query("win_round_robin", f"WITH {LISTS}, {RR.format(b='lower(brand)')} SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY rn, f) AS new_pos FROM x")
def _(e):
    df = lists(e).withColumn("bk", windows.brand_key(C("brand"), C("retailer")))
    return windows.round_robin(df, ["lane"], "bk", "lpos").select("lane", "object_id", "new_pos")


@query("win_round_robin_2level", f"""WITH {LISTS}, l AS (SELECT *, CASE WHEN tag IN ('edgy', 'minimalist', 'casual', 'preppy') THEN tag ELSE '__unknown__' END AS a FROM lists),
    x AS (SELECT *, row_number() OVER (PARTITION BY lane, a, brand ORDER BY lpos) AS rn, min(lpos) OVER (PARTITION BY lane, a, brand) AS f, min(lpos) OVER (PARTITION BY lane, a) AS fa FROM l),
    y AS (SELECT *, row_number() OVER (PARTITION BY lane, a ORDER BY rn, f) AS q FROM x) SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY q, fa) AS new_pos FROM y""")
def _(e):
    known = F.filter("aesthetic_tags", lambda t: t.isin(list(vocab.FEED_AESTHETICS)))
    df = lists(e).withColumn("bk", windows.brand_key(C("brand"), C("retailer"))).withColumn("ak", F.coalesce(F.get(known, F.lit(0)), F.lit(windows.OTHER)))
    return windows.round_robin_2level(df, ["lane"], "ak", "bk", "lpos").select("lane", "object_id", "new_pos")


@query("win_price_band_sample", """WITH b AS (SELECT object_id, category, price, CASE WHEN price > 210 AND price <= 300 THEN 0 WHEN price > 120 AND price <= 210 THEN 1 WHEN price > 60 AND price <= 120 THEN 2 WHEN price > 24 AND price <= 60 THEN 3 WHEN price <= 24 THEN 4 END AS band FROM products),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, band ORDER BY price DESC, object_id) AS rn FROM b WHERE band IS NOT NULL)
    SELECT category, object_id, row_number() OVER (PARTITION BY category ORDER BY rn, band) AS new_pos FROM r WHERE rn <= 20""")
def _(e):
    return windows.price_band_sample(e.products, 300, per_band=20, keys=["category"]).select("category", "object_id", "new_pos")


@query("win_catalog_slices", """WITH r AS (SELECT object_id, row_number() OVER (ORDER BY price DESC NULLS LAST, object_id) - 1 AS p, greatest(1, count(*) OVER () // 96) AS span FROM products),
    s AS (SELECT object_id, p % 12 AS w, (p // 12 - 1) // span AS s FROM r WHERE p // 12 >= 1 AND (p // 12 - 1) % span = 0 AND (p // 12 - 1) // span < 8)
    SELECT object_id, row_number() OVER (ORDER BY w, s) AS new_pos FROM s""")
def _(e):
    return windows.catalog_slices(e.products, [C("price").desc_nulls_last(), "object_id"], page=1).select("object_id", "new_pos")


@query("win_rank_fraction", f"WITH {LISTS} SELECT lane, object_id, round(CASE WHEN count(*) OVER (PARTITION BY lane) = 1 THEN 1.0 ELSE 1 - (lpos - 1) / (count(*) OVER (PARTITION BY lane) - 1) END, 6) AS fraction FROM lists")
def _(e):
    return windows.rank_fraction(lists(e), ["lane"], "lpos").select("lane", "object_id", F.round("fraction", 6).alias("fraction"))


HITS = """hk AS (SELECT s.user_token, lower(brand) AS brand, lower(color) AS color, lower(category) AS category, CASE WHEN row_number() OVER (PARTITION BY s.user_token ORDER BY ts DESC, event_id DESC) <= 3 THEN 2 ELSE 1 END AS h FROM signals s JOIN products USING (object_id) WHERE kind = 'click'),
    hits AS (SELECT user_token, feature, value, CAST(sum(h) AS BIGINT) AS hits FROM (SELECT user_token, 'brand' AS feature, brand AS value, h FROM hk UNION ALL SELECT user_token, 'color', color, h FROM hk UNION ALL SELECT user_token, 'category', category, h FROM hk) WHERE value <> '' GROUP BY 1, 2, 3)"""


@query("win_weighted_recency_hits", f"WITH {HITS} SELECT * FROM hits")
def _(e):
    from modiste.workload.aggregates import clicks

    return windows.weighted_recency_hits(clicks(e), ["brand", "color", "category"])


@query("win_diversity_slots", """WITH b AS (SELECT user_token, object_id, pos FROM (SELECT user_token, object_id, row_number() OVER (PARTITION BY user_token ORDER BY ts DESC, event_id DESC) AS pos FROM signals WHERE kind <> 'dislike')),
    x AS (SELECT user_token, object_id, pos FROM (SELECT user_token, object_id, row_number() OVER (PARTITION BY user_token ORDER BY ts DESC, event_id DESC) AS pos FROM signals WHERE kind = 'dislike') WHERE pos <= 10),
    nb AS (SELECT user_token, count(*) AS nb FROM b GROUP BY 1), ne AS (SELECT user_token, count(*) AS ne FROM x GROUP BY 1)
    SELECT user_token, object_id, 1 + CASE WHEN coalesce(ne, 0) > 0 AND nb > 16 AND pos > 16 THEN pos - 1 + least((pos - 17) // 3, ne) ELSE pos - 1 END AS new_pos, false AS exploratory FROM b JOIN nb USING (user_token) LEFT JOIN ne USING (user_token)
    UNION ALL SELECT user_token, object_id, 1 + 16 + pos - 1 + least(3 * pos, nb - 16), true FROM x JOIN nb USING (user_token) WHERE nb > 16""")
def _(e):
    from modiste.scale import numbered

    order = [C("ts").desc(), C("event_id").desc()]
    b = numbered(e.signals.where("kind <> 'dislike'"), ["user_token"], order, "pos")
    x = first_k(e.signals.where("kind = 'dislike'"), ["user_token"], order, 10, "pos")
    return windows.diversity_slots(b, x, ["user_token"])


@query("win_position", "SELECT object_id, row_number() OVER (PARTITION BY brand ORDER BY price NULLS FIRST, object_id) AS position FROM products")
def _(e):
    return windows.position(e.products, ["brand"], [C("price").asc_nulls_first(), "object_id"]).select("object_id", "position")


@query("win_train_split", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('s1|', CAST(event_id AS VARCHAR))), CAST(event_id AS VARCHAR)) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM signals")
def _(e):
    return windows.train_split(e.signals.select("event_id"), C("event_id").cast("string"), "s1").select("event_id", "split")
