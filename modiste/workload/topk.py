"""Registered queries of nearest neighbours, ordering and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import joins, topk
from modiste.plans.retrieval import with_categories
from modiste.scale import first_k, numbered
from modiste.workload.fixtures import query
from modiste.workload.joins import AFFINITY, affinity
from modiste.workload.windows import LISTS, lists

C = F.col


def near(name: str, q: str, v: str, k: int, key: str = "query_id", group: str | None = None, floor: float | None = None, more: str = "") -> str:
    """CTE with the k nearest rows; `more` lists further columns of q."""
    part = f"q.{key}" + (f", v.{group}" if group else "")
    cols = f"q.{key}" + (f", v.{group}" if group else "") + (f", {more}" if more else "")
    keep = f" AND score >= {floor}" if floor is not None else ""
    out = key + (f", {group}" if group else "") + (", " + ", ".join(x.split(".")[-1] for x in more.split(", ")) if more else "")
    return (f"{name} AS (SELECT {out}, rank, object_id, score FROM (SELECT {cols}, v.object_id, round(list_cosine_similarity(q.vec, v.vec), 6) + 0.0 AS score, "
            f"row_number() OVER (PARTITION BY {part} ORDER BY round(list_cosine_similarity(q.vec, v.vec), 6) + 0.0 DESC, v.object_id) AS rank FROM {q} q, {v} v) WHERE rank <= {k}{keep})")


CATVEC = "catvec AS (SELECT v.object_id, category, vec FROM vectors v JOIN products USING (object_id))"


@query("topk_vector", f"WITH {CATVEC}, {near('n', 'queries', 'catvec', 20, group='category', floor=0.05)} SELECT * FROM n")
def _(e):
    return topk.nearest(e.queries, with_categories(e.vectors, e.products), 20, 0.05, group="category")


def clusters(e):
    return e.phrases.select("query_id", C("phrase").alias("cluster"), (C("phrase") / 10).alias("weight"), "vec")


CLUSTERED = (f"cl AS (SELECT query_id * 10 + phrase AS cid, query_id, phrase / 10.0 AS weight, vec FROM phrases), {near('h', 'cl', 'vectors', 120, 'cid', more='q.query_id, q.weight')}, "
             "f AS (SELECT query_id, object_id, round(sum(score * weight), 9) AS score FROM h WHERE rank <= greatest(10, floor(40 * weight + 0.5)) AND score >= 0.05 GROUP BY 1, 2)")


@query("topk_clustered", f"WITH {CLUSTERED} SELECT query_id, object_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM f) WHERE rank <= 40".replace("phrase / 10.0", "CAST(phrase AS DOUBLE) / 10"))
def _(e):
    return topk.clustered(clusters(e), e.vectors, 40, 0.05).withColumn("score", F.round("score", 6))


FOUND = (f"{CATVEC}, pp AS (SELECT query_id * 10 + phrase AS pid, query_id, phrase, vec FROM phrases), {near('ph', 'pp', 'catvec', 20, 'pid', 'category', 0.05, 'q.query_id, q.phrase')}, "
         "pf AS (SELECT query_id, category, object_id, min(phrase * 1000 + rank) AS f FROM ph GROUP BY 1, 2, 3)")
UNITED = "SELECT query_id, category, object_id, row_number() OVER (PARTITION BY query_id, category ORDER BY f, object_id) AS rank FROM pf"
#: as far as a gate reads it
UNION = f"{FOUND}, sem AS (SELECT * FROM ({UNITED}) WHERE rank <= 60)"


@query("topk_per_phrase_union", f"WITH {FOUND} {UNITED}")
def _(e):
    return topk.per_phrase_union(e.phrases, with_categories(e.vectors, e.products), 20, 0.05)


@query("sort_price_nulls_last", f"""WITH {LISTS} SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY price NULLS LAST, lpos) AS up, row_number() OVER (PARTITION BY lane ORDER BY price DESC NULLS LAST, lpos) AS down FROM lists""")
def _(e):
    up = topk.price_nulls_last(lists(e), ["lane"], pos="lpos", out="up")
    return topk.price_nulls_last(up, ["lane"], True, "lpos", "down").select("lane", "object_id", "up", "down")


BOOSTS = "bo AS (SELECT lane, object_id, rank FROM (SELECT category AS lane, object_id, row_number() OVER (PARTITION BY category ORDER BY size, object_id) AS rank FROM products) WHERE rank <= 24)"


def boosts(e):
    return first_k(e.products.select(C("category").alias("lane"), "object_id", "size"), ["lane"], ["size", "object_id"], 24, "rank")


@query("sort_boost_front", f"WITH {LISTS}, {BOOSTS} SELECT lane, l.object_id, row_number() OVER (PARTITION BY lane ORDER BY rank NULLS LAST, lpos) AS new_pos FROM lists l LEFT JOIN bo USING (lane, object_id)")
def _(e):
    return topk.boost_front(lists(e), boosts(e), ["lane"], pos="lpos").select("lane", "object_id", "new_pos")


@query("sort_partition_demote", f"""WITH {LISTS}, {AFFINITY}, d AS (SELECT trim(lower(brand)) AS k, young FROM affinity)
    SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY coalesce(a.young, b.young, 'dress') <> 'dress', lpos) AS new_pos FROM lists l LEFT JOIN d a ON a.k = lower(l.brand) LEFT JOIN d b ON b.k = lower(l.retailer)""")
def _(e):
    df = joins.brand_dim(lists(e), affinity(e))
    return topk.partition_demote(df, ["lane"], joins.age_matches(C("preferred_ages"), F.lit("dress")), "lpos").select("lane", "object_id", "new_pos")


@query("page_offset", f"WITH {LISTS} SELECT lane, lpos, object_id, count(*) OVER (PARTITION BY lane) > 100 AS has_more FROM lists QUALIFY lpos > 50 AND lpos <= 100")
def _(e):
    return topk.page_offset(lists(e), ["lane"], 1, 50, "lpos").select("lane", "lpos", "object_id", "has_more")


LOOSE = """r AS (SELECT q.query_id, p.object_id, p.price, q.text, q.price_range AS want, p.* EXCLUDE (object_id, price) FROM queries q JOIN products p ON split_part(p.title, ' ', 2) = split_part(q.text, ' ', 2)),
    l AS (SELECT query_id, object_id, 0 AS level, pos FROM r WHERE title = text AND price_range = want UNION ALL SELECT query_id, object_id, 1, pos FROM r WHERE title = text UNION ALL SELECT query_id, object_id, 2, pos FROM r)"""


@query("page_loosen", f"""WITH {LOOSE}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY pos, object_id) AS rr FROM l) WHERE rr <= 72),
    f AS (SELECT query_id, object_id, min(level * 1000000000 + pos) AS f, min(level) AS level FROM c GROUP BY 1, 2)
    SELECT query_id, object_id, CAST(level AS INTEGER) AS level, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, object_id) AS position FROM f) WHERE position <= 24""")
def _(e):
    q = e.queries.select("query_id", "text", C("price_range").alias("want"), F.split_part("text", F.lit(" "), F.lit(2)).alias("w"))
    p = e.products.select("object_id", "pos", C("title").alias("text"), C("price_range").alias("want"), F.split_part("title", F.lit(" "), F.lit(2)).alias("w"))
    # the order doesn't depend on the query, so a level takes the first rows of each key before the join
    first = lambda *keys: first_k(p, list(keys), ["pos", "object_id"], 3 * 24).select(*keys, "object_id", "pos")
    levels = [q.join(first("text", "want"), ["text", "want"]), q.join(first("text"), "text"), q.join(first("w"), "w")]
    return topk.page_loosen(levels, ["query_id"], 24).select("query_id", "object_id", "level", "position")


@query("topk_sample_per_group", "SELECT brand, object_id FROM (SELECT brand, object_id, row_number() OVER (PARTITION BY brand ORDER BY object_id) AS rn FROM products) WHERE rn <= 25")
def _(e):
    return topk.sample_per_group(e.products.select("brand", "object_id"), ["brand"], 25)
