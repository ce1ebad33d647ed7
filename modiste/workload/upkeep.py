"""Registered queries of catalogue upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from modiste import vocab
from modiste.operators import topk
from modiste.plans import maintenance
from modiste.workload.fixtures import query, quoted
from modiste.workload.joins import RULE_SQL, RULES
from modiste.workload.topk import near

C = F.col


@query("maint_mistag_audit", f"""WITH h AS (SELECT object_id, rule, action, target FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS rn FROM ({RULE_SQL})) WHERE rn = 1)
    SELECT p.object_id, coalesce(h.target, p.category) AS category, coalesce(rule, '') AS rule FROM products p LEFT JOIN h USING (object_id) WHERE coalesce(h.action, '') <> 'delete'""")
def _(e):
    flagged, fixed = maintenance.mistag_audit(e.products, RULES)
    return fixed.join(flagged.select("object_id", "rule"), "object_id", "left").select("object_id", "category", F.coalesce("rule", F.lit("")).alias("rule"))


WORN = ["mascara", "candle", "bikini", "bikini dress", "monokini", "tankini top", "tankini", "tankini top with monokini", "tankini tankini top", "sneaker", "sneaker bag", "tote bag", "maxi dress", "crop top", "jeans", "jeans set", ""]


def audit_sql() -> str:
    """The nine audit rules, first match wins. The twin's engine has no look-ahead: a swim top or bottom is taken out of the title before."""
    out = []
    for i, (name, pattern, excuse, wrong, target) in enumerate(vocab.AUDIT_RULES):
        title = "t"
        if "(?!" in pattern:
            pattern, title = pattern.replace("(?! top| bottom)", ""), "regexp_replace(t, 'tankini( top| bottom)', '#', 'g')"
        hit = f"category IN ({', '.join(quoted(w) for w in wrong)}) AND regexp_matches({title}, {quoted(pattern)})" + (f" AND NOT regexp_matches(t, {quoted(excuse)})" if excuse else "")
        out.append(f"SELECT object_id, {i} AS ord, '{name}' AS rule, '{'recategorize' if target else 'delete'}' AS action, {quoted(target) if target else 'CAST(NULL AS VARCHAR)'} AS target FROM w WHERE {hit}")
    worn = f"w AS (SELECT object_id, category, concat(title, ' ', ([{', '.join(map(quoted, WORN))}])[1 + pos % {len(WORN)}]) AS t FROM products)"
    return f"WITH {worn} SELECT object_id, rule, action, target FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS rn FROM ({' UNION ALL '.join(out)})) WHERE rn = 1"


@query("maint_mistag_rules", audit_sql())
def _(e):
    worn = F.element_at(F.array(*map(F.lit, WORN)), (C("pos") % len(WORN) + 1).cast("int"))
    flagged, _ = maintenance.mistag_audit(e.products.withColumn("title", F.concat_ws(" ", "title", worn)))
    return flagged.select("object_id", "rule", "action", "target")


@query("maint_price_purge", """SELECT 'products' AS part, object_id, NULL AS n FROM products WHERE price IS NULL OR price <= 250 UNION ALL SELECT 'vectors', object_id, NULL FROM vectors WHERE object_id NOT IN (SELECT object_id FROM products WHERE price > 250)
    UNION ALL SELECT 'report', brand, count(*) FROM products WHERE price > 250 GROUP BY brand""")
def _(e):
    p = maintenance.price_purge(e.products, e.vectors, 250)
    none = F.lit(None).cast("long").alias("n")
    parts = [p["products"].select(F.lit("products").alias("part"), "object_id", none), p["vectors"].select(F.lit("vectors").alias("part"), "object_id", none),
             p["report"].select(F.lit("report").alias("part"), C("brand").alias("object_id"), "n")]
    return reduce(lambda a, b: a.unionByName(b), parts)


TARGETS = [("brand#1", "Small Ring"), ("Brand#2", "hot")]


@query("maint_delete_targets", """SELECT object_id, CASE WHEN price = 0 AND NOT t1 AND NOT t2 THEN 'price=$0' WHEN t2 THEN 'title: Brand#2 / hot' WHEN t1 THEN 'title: brand#1 / Small Ring' ELSE 'listed' END AS reason
    FROM (SELECT *, contains(lower(brand), 'brand#1') AND contains(title, 'small ring') AS t1, contains(lower(brand), 'brand#2') AND contains(title, 'hot') AS t2 FROM products) WHERE price = 0 OR t1 OR t2 OR object_id = 'p-5'""")
def _(e):
    gone, _, _ = maintenance.delete_targets(e.products, TARGETS, ["p-5"])
    return gone.select("object_id", "reason")


@query("maint_delete_by_query", """WITH d AS (SELECT object_id FROM products WHERE (SELECT count(*) FROM (VALUES ('red'), ('ring')) x(w) WHERE list_contains(regexp_split_to_array(lower(concat_ws(' ', title, brand, description, color, material, tag, retailer, category)), '[^\\p{L}\\p{N}]+'), w)) = 2 ORDER BY price DESC NULLS LAST, object_id)
    SELECT 'deleted' AS part, count(*) AS n FROM d UNION ALL SELECT 'products', count(*) FROM products WHERE object_id NOT IN (SELECT object_id FROM d) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE object_id NOT IN (SELECT object_id FROM d)""")
def _(e):
    parts = maintenance.delete_by_query(e.products, e.vectors, "red ring", most=100_000)
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()])


@query("maint_incremental", "SELECT object_id FROM products WHERE object_id NOT IN (SELECT object_id FROM vibes)")
def _(e):
    return maintenance.incremental(e.products, e.vibes).select("object_id")


@query("maint_ghost_report", f"WITH {near('h', 'queries', 'vectors', 25)} SELECT query_id, rank, object_id FROM h WHERE object_id NOT IN (SELECT object_id FROM products WHERE price < 200)")
def _(e):
    return maintenance.ghost_report(topk.nearest(e.queries, e.vectors, 25), e.products.where("price < 200")).select("query_id", "rank", "object_id")


@query("maint_brand_purge", """SELECT 'products' AS part, object_id FROM products WHERE brand <> 'Brand#7' UNION ALL SELECT 'vectors', object_id FROM vectors WHERE object_id NOT IN (SELECT object_id FROM products WHERE brand = 'Brand#7')
    UNION ALL SELECT 'deleted', object_id FROM products WHERE brand = 'Brand#7'""")
def _(e):
    p = maintenance.brand_purge(e.products, e.vectors, "Brand#7")
    parts = [p[k].select(F.lit(n).alias("part"), "object_id") for k, n in (("products", "products"), ("vectors", "vectors"), ("deleted", "deleted"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("maint_backfill_page", """SELECT event_id, position FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM signals JOIN products USING (object_id) WHERE kind = 'save' AND category NOT IN ('bag', 'shoes')) WHERE position > 100 AND position <= 200""")
def _(e):
    entries = e.signals.where("kind = 'save'").join(e.products.select("object_id", F.array(F.initcap("category"), F.lit("x")).alias("boards")), "object_id")
    return maintenance.backfill_page(entries, 1, 100, ["BAG", "shoes"]).select("event_id", "position")
