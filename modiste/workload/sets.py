"""Registered queries of the ordered set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import sets, topk
from modiste.plans.retrieval import keyword_search, with_categories
from modiste.scale import broadcast_measured, first_k, numbered
from modiste.session import cut
from modiste.workload.fixtures import query
from modiste.workload.joins import LIKES, likes
from modiste.workload.topk import UNION

C = F.col

WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
TERMS = ("pt AS (" + " UNION ALL ".join(
    f"SELECT object_id, {i} AS a, unnest({WORDS.format(c)}) AS t FROM products" for i, c in enumerate(("title", "brand", "description", "color", "material", "tag", "retailer", "category"))) + ")")


def keyword_sql(name: str, src: str, text: str = "text", keys: str = "query_id", group: str = "", k: int | None = 50, optional: bool = False, neg: str | None = None, cond: str = "true", boosts: str = "0",
                need_terms: bool = True) -> str:
    """CTEs giving (keys, [group], rank, object_id) of the keyword search over source rows with a text."""
    g = (keys + (", " + group if group else ""))
    qk = ", ".join(f"q.{x.strip()}" for x in keys.split(","))
    gk = qk + (f", p.{group}" if group else "")
    size = "" if optional else f" HAVING count(DISTINCT m.t) = any_value(nw)"
    block = f" AND NOT EXISTS (SELECT 1 FROM pt x WHERE x.object_id = p.object_id AND x.t = {neg})" if neg else ""
    lim = f" WHERE rank <= {k}" if k else ""
    return ((TERMS + ", " if need_terms else "") + f"{name}_w AS (SELECT *, unnest(ws) AS w, len(ws) AS nw FROM (SELECT *, {WORDS.format(text)} AS ws FROM {src})), "
            f"{name}_m AS (SELECT {qk}, m.object_id, count(DISTINCT m.t) AS matched, min(m.a) AS best FROM {name}_w q JOIN pt m ON m.t = q.w GROUP BY {qk}, m.object_id{size}), "
            f"{name} AS (SELECT * FROM (SELECT {gk}, p.object_id, q.matched, q.best, row_number() OVER (PARTITION BY {gk} ORDER BY q.matched DESC, q.best, {boosts} DESC, p.price DESC NULLS LAST, p.object_id) AS rank "
            f"FROM {name}_m q JOIN products p USING (object_id) JOIN {src} s ON {' AND '.join(f's.{x.strip()} = q.{x.strip()}' for x in keys.split(','))} WHERE {cond}{block}){lim})")


@query("set_union_distinct_ordered", """WITH l AS (SELECT user_token, object_id, CASE kind WHEN 'save' THEN 0 WHEN 'like' THEN 1 ELSE 2 END AS list_id, event_id AS rank FROM signals WHERE kind IN ('save', 'like', 'click')),
    f AS (SELECT user_token, object_id, min(list_id * 1000000000 + rank) AS f FROM l GROUP BY 1, 2) SELECT user_token, object_id, row_number() OVER (PARTITION BY user_token ORDER BY f, object_id) AS pos FROM f""")
def _(e):
    order = F.when(C("kind") == "save", 0).when(C("kind") == "like", 1).otherwise(2)
    l = e.signals.where("kind IN ('save', 'like', 'click')").select("user_token", "object_id", order.alias("list_id"), C("event_id").alias("rank"))
    return sets.union_distinct_ordered(l, ["user_token"])


POOL_SQL = f"""{UNION}, {keyword_sql('kw', 'queries', group='category', k=30)},
    s AS (SELECT query_id, category, object_id, row_number() OVER (PARTITION BY query_id, category ORDER BY rank, object_id) AS r FROM sem WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.rank <= 15 AND kw.query_id = sem.query_id AND kw.category = sem.category AND kw.object_id = sem.object_id)),
    u AS (SELECT query_id, category, object_id, 0 AS src, rank AS r FROM kw WHERE rank <= 15 UNION ALL SELECT query_id, category, object_id, 1, r FROM s WHERE r <= 10),
    gate AS (SELECT query_id, category, object_id, CASE src WHEN 0 THEN 'keyword' ELSE 'semantic' END AS source, row_number() OVER (PARTITION BY query_id, category ORDER BY src, r) AS pos FROM u)"""


def gate(e):
    keyword = keyword_search(e.queries.select("query_id", "text"), e.tagged, 30, order_group=["category"])
    semantic = topk.per_phrase_union(e.phrases, with_categories(e.vectors, e.products), 20, 0.05)
    return sets.pool_merge(keyword, semantic, ["query_id", "category"], 15, 10)


@query("set_pool_merge", f"WITH {POOL_SQL} SELECT * FROM gate")
def _(e):
    return gate(e)


@query("set_fallback_widen", """WITH q AS (SELECT query_id, text, split_part(text, ' ', 1) AS w1, split_part(text, ' ', 2) AS w2, price_range FROM queries),
    t AS (SELECT query_id, object_id, 0 AS tier, pos AS rank FROM q JOIN products p ON p.title = q.text AND p.category = 'dress' UNION ALL SELECT query_id, object_id, 1, pos FROM q JOIN products p ON p.title = q.text
      UNION ALL SELECT query_id, object_id, 2, pos FROM q JOIN products p ON split_part(p.title, ' ', 2) = q.w2),
    f AS (SELECT query_id, object_id, min(tier * 1000000000 + rank) AS f, min(tier) AS tier FROM t GROUP BY 1, 2),
    n AS (SELECT query_id, count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier <= 1) AS n1 FROM f GROUP BY 1)
    SELECT query_id, object_id, CAST(tier AS INTEGER) AS tier, row_number() OVER (PARTITION BY query_id ORDER BY f, object_id) AS pos FROM f JOIN n USING (query_id) WHERE tier <= CASE WHEN n0 >= 5 THEN 0 WHEN n1 >= 30 THEN 1 ELSE 2 END""")
def _(e):
    p = e.products.select("object_id", "category", C("title").alias("text"), C("pos").alias("rank"), F.split_part("title", F.lit(" "), F.lit(2)).alias("w2"))
    exact = lambda rows: rows.drop("w2").join(p.drop("w2"), "text")
    tiers = [lambda rows: exact(rows).where("category = 'dress'"), exact, lambda rows: rows.drop("text").join(p.drop("text"), "w2")]
    # what a query gets depends on its texts alone: queries that ask for the same are widened once, and each is given the result
    asking = cut(e.queries.groupBy("query_id").agg(F.sort_array(F.collect_set("text")).alias("texts")))
    asked = asking.select("texts").distinct().select("texts", F.explode("texts").alias("text")).withColumn("w2", F.split_part("text", F.lit(" "), F.lit(2)))
    found = sets.fallback_widen(asked, tiers, ["texts"], [5, 30])
    return broadcast_measured(asking).join(found, "texts").select("query_id", "object_id", "tier", "pos")


BUCKETS = "qb AS (SELECT query_id, bucket, text, CASE WHEN bucket = 'bottom' THEN concat(text, ' skirt') WHEN bucket = 'dress' OR contains(lower(text), bucket) THEN text ELSE concat(text, ' ', bucket) END AS text1, array_to_string(string_split(text, ' ')[-2:], ' ') AS text2 FROM queries, (VALUES ('dress'), ('bottom'), ('bag')) b(bucket))"


@query("set_category_fallback", f"""WITH {BUCKETS}, {keyword_sql('t0', 'qb', keys='query_id, bucket', k=8, cond='p.category = q.bucket')}, {keyword_sql('t1', 'qb', 'text1', 'query_id, bucket', k=8, need_terms=False)}, {keyword_sql('t2', 'qb', 'text2', 'query_id, bucket', k=4, need_terms=False)},
    t AS (SELECT query_id, bucket, object_id, 0 AS tier, rank FROM t0 UNION ALL SELECT query_id, bucket, object_id, 1, rank FROM t1 UNION ALL SELECT query_id, bucket, object_id, 2, rank FROM t2),
    f AS (SELECT query_id, bucket, object_id, min(tier * 1000000000 + rank) AS f, min(tier) AS tier FROM t GROUP BY 1, 2, 3), n AS (SELECT query_id, bucket, count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier <= 1) AS n1 FROM f GROUP BY 1, 2)
    SELECT query_id, bucket, object_id, CAST(tier AS INTEGER) AS tier, row_number() OVER (PARTITION BY query_id, bucket ORDER BY f, object_id) AS pos FROM f JOIN n USING (query_id, bucket) WHERE tier <= CASE WHEN n0 >= 2 THEN 0 WHEN n1 >= 2 THEN 1 ELSE 2 END""")
def _(e):
    from modiste.plans.retrieval import category_search

    q = e.queries.select("query_id", "text", F.explode(F.array(F.lit("dress"), F.lit("bottom"), F.lit("bag"))).alias("bucket"))
    return category_search(q, e.products, 4).select("query_id", "bucket", "object_id", "tier", "pos")


@query("set_pad_min", """WITH r AS (SELECT query_id, p.category, object_id, row_number() OVER (PARTITION BY query_id, p.category ORDER BY pos) AS rank FROM queries q JOIN products p ON p.title = q.text AND p.brand = concat('Brand#', CAST(1 + query_id % 25 AS VARCHAR))),
    t AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), g AS (SELECT query_id, object_id, pos AS rank FROM queries q JOIN products p ON p.title = q.text),
    x AS (SELECT g.* FROM g LEFT JOIN t USING (query_id) WHERE coalesce(n, 0) < 6 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = g.query_id AND r.object_id = g.object_id)),
    y AS (SELECT query_id, object_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, object_id) AS rn FROM x), h AS (SELECT query_id, count(*) AS have FROM r WHERE category = 'dress' GROUP BY 1),
    u AS (SELECT query_id, category, object_id, 0 AS src, rank FROM r UNION ALL SELECT query_id, 'dress', object_id, 1, rank FROM y LEFT JOIN h USING (query_id) WHERE rn + coalesce(have, 0) <= 8)
    SELECT query_id, category, object_id, row_number() OVER (PARTITION BY query_id, category ORDER BY src, rank, object_id) AS pos FROM u""")
def _(e):
    q = e.queries.select("query_id", "text", F.concat(F.lit("Brand#"), (C("query_id") % 25 + 1).cast("string")).alias("brand"))
    p = e.products.select("object_id", "category", "brand", "pos", C("title").alias("text"))
    res = numbered(q.join(p, ["text", "brand"]), ["query_id", "category"], ["pos"], "rank").select("query_id", "category", "object_id", "rank")
    # at most eight are filled in where a query has fewer than six results, so fourteen per text are enough
    head = first_k(p.drop("brand"), ["text"], ["pos", "object_id"], 14)
    generic = q.drop("brand").join(head, "text").select("query_id", "object_id", C("pos").alias("rank"))
    return sets.pad_min(res, generic, ["query_id"], F.lit("dress"))


@query("set_except_rejected", "SELECT user_token, object_id FROM signals GROUP BY 1, 2 HAVING max(CASE WHEN kind IN ('click', 'save') THEN 1 ELSE 0 END) = 0")
def _(e):
    return sets.except_rejected(e.signals, ["user_token"], C("kind").isin("click", "save"))


@query("set_orphan_vectors", """SELECT 'visual' AS namespace, object_id FROM vectors WHERE object_id NOT IN (SELECT object_id FROM products WHERE price < 300) UNION ALL
    SELECT 'vibe', object_id FROM vibes WHERE object_id NOT IN (SELECT object_id FROM products WHERE price < 300)""")
def _(e):
    both = e.vectors.select(F.lit("visual").alias("namespace"), "object_id").unionByName(e.vibes.select(F.lit("vibe").alias("namespace"), "object_id"))
    return sets.orphan_vectors(both, e.products.where("price < 300"))


LABELS = ["dress", "top", "edgy", "casual", "red", "unused"]


@query("set_label_complement", f"""SELECT l AS label, object_id, l IN (category, tag, color) AS kept FROM products, (VALUES {", ".join(f"('{x}')" for x in LABELS)}) x(l) WHERE NOT (tag = '' AND color = '')""")
def _(e):
    items = e.products.where("NOT (tag = '' AND color = '')").select("object_id", F.filter(F.array("category", "tag", "color"), lambda x: x != "").alias("labels"))
    return sets.label_complement(items, LABELS)
