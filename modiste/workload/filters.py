"""Registered queries of the filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import steer, text
from modiste.operators import filters
from modiste.scale import broadcast_measured
from modiste.workload.fixtures import query, quoted
from modiste.workload.scalars import PARSED, in_list, rx

C = F.col
IDS = "SELECT object_id FROM products WHERE "


def starts(words) -> str:
    return quoted(text.word_starts(words))


@query("flt_image_valid", """SELECT object_id, 'length' AS mode FROM products WHERE length(image_url) > 20 AND NOT contains(image_url, 'blank.gif') AND NOT contains(image_url, 'placeholder')
    UNION ALL SELECT object_id, 'http' FROM products WHERE starts_with(image_url, 'http') AND NOT contains(image_url, 'placeholder')""")
def _(e):
    a = filters.image_valid(e.products).select("object_id", F.lit("length").alias("mode"))
    return a.unionByName(filters.image_valid(e.products, mode="http").select("object_id", F.lit("http").alias("mode")))


@query("flt_price_band", """SELECT object_id, b AS band FROM products, (VALUES ('budget'), ('mid'), ('luxury')) x(b)
    WHERE (b = 'budget' AND price_range = 'budget') OR (b = 'mid' AND price_range IN ('mid', 'budget')) OR (b = 'luxury' AND price_range IN ('luxury', 'mid'))""")
def _(e):
    parts = [filters.price_band(e.products, b).select("object_id", F.lit(b).alias("band")) for b in ("budget", "mid", "luxury")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("flt_axis_range", """SELECT p.object_id FROM products p JOIN axes a USING (object_id) WHERE formality >= 0.4 AND edge BETWEEN 0.25 AND 0.75 AND price_range IN ('luxury', 'mid')
    AND category IN ('dress', 'top', 'bag')""")
def _(e):
    j = e.products.join(e.axes, "object_id")
    return filters.axis_range(j, {"formality": 0.4, "edge": (0.25, 0.75)}, "luxury", ["dress", "top", "bag"]).select("object_id")


@query("flt_min_score", "SELECT object_id, round(formality, 6) AS score FROM axes WHERE round(formality, 6) >= 0.55")
def _(e):
    return filters.min_score(e.axes.select("object_id", F.round("formality", 6).alias("score")), 0.55)


@query("flt_price_max", IDS + "price IS NULL OR price <= 120")
def _(e):
    return filters.price_max(e.products, 120).select("object_id")


@query("flt_compose", IDS + "(category = 'dress' OR brand = 'Brand#1') AND price <= 250")
def _(e):
    return e.products.where(filters.compose((C("category") == "dress") | (C("brand") == "Brand#1"), C("price") <= 250, None)).select("object_id")


@query("flt_steer_post", f"""WITH {PARSED}, c AS (SELECT x.event_id, x.price_range AS want, x.categories, x.colors, list_filter(x.avoid_terms, lambda a: length(a) > 2) AS avoid_terms, p.* FROM parsed x
      JOIN signals s ON s.event_id = x.event_id JOIN products p ON p.object_id = s.object_id)
    SELECT event_id, object_id FROM c WHERE (want IS NULL OR price_range = '' OR price_range = want)
      AND (len(categories) = 0 OR category = '' OR len(list_filter(categories, lambda k: contains(category, k) OR contains(k, category))) > 0)
      AND (len(colors) = 0 OR color = '' OR len(list_filter(colors, lambda k: contains(color, k))) > 0)
      AND len(list_filter(avoid_terms, lambda a: contains(lower(concat(title, ' ', description, ' ', category, ' ', color, ' ', material, ' ', tag)), a))) = 0""")
def _(e):
    s = e.steers.select("event_id", "object_id", steer.steer_parse(C("raw_text")).alias("steer"))
    return filters.steer_post(s.join(e.tagged, "object_id")).select("event_id", "object_id")


@query("flt_avoid_keywords", """SELECT object_id FROM products WHERE NOT (contains(hay, 'rings') OR contains(hay, 'ring-ring') OR contains(hay, 'plate') OR (contains(hay, lower(material)) AND coalesce(price, 999) < 200))
    """.replace("FROM products", "FROM (SELECT *, lower(concat(title, ' ', description, ' ', color, ' ', tag)) AS hay FROM products)"))
def _(e):
    phrases = F.array(F.lit("no rings!"), F.lit("a plate, red"), F.when(C("price") < 200, C("material")).otherwise(""))
    return filters.avoid_keywords(e.tagged, phrases, ("title", "description", "color", "aesthetic_tags")).select("object_id")


@query("flt_mens", rf"SELECT object_id FROM products WHERE NOT regexp_matches(lower(concat(t, ' ', description)), {quoted(vocab.MENS_PHRASE)})".replace(
    "FROM products", "FROM (SELECT *, CASE brand WHEN 'Brand#1' THEN concat('Men''s ', title) WHEN 'Brand#2' THEN concat('women ', title) WHEN 'Brand#3' THEN concat(title, ' for  him') ELSE title END AS t FROM products)"))
def _(e):
    t = (F.when(C("brand") == "Brand#1", F.concat(F.lit("Men's "), "title")).when(C("brand") == "Brand#2", F.concat(F.lit("women "), "title"))
         .when(C("brand") == "Brand#3", F.concat("title", F.lit(" for  him"))).otherwise(C("title")))
    return filters.mens(e.products.withColumn("title", t)).select("object_id")


LANES = ["tops", "dresses", "bottoms", "shoes", "outerwear", "bags and accessories", "knits", "other"]
LANE_BLOCKERS = {**vocab.LANE_TITLE_BLOCKERS, "dresses": ["anvil", "rod"], "bottoms": ["gear", "plate"]}
LANE_SQL = " ".join(f"WHEN lane = '{n}' AND regexp_matches(title, {starts(w)}) THEN false" for n, w in LANE_BLOCKERS.items())
LANE_CAT = " ".join(f"WHEN lane = '{n}' AND category <> '{c}' THEN false" for n, c in vocab.CATEGORY_SLUGS.items())


@query("flt_category_blockers", f"""SELECT object_id, lane FROM products, (VALUES {", ".join(f"('{x}')" for x in LANES)}) x(lane)
    WHERE CASE {LANE_SQL} {LANE_CAT} WHEN lane = 'knits' AND NOT regexp_matches(title, {starts(['ring', 'gizmo'])}) THEN false WHEN lane = 'other' AND category IN ({in_list(vocab.CATEGORIES)}) THEN false ELSE true END""")
def _(e):
    lanes = e.products.withColumn("lane", F.explode(text.lit_array(LANES)))
    return filters.category_blockers(lanes, blockers=LANE_BLOCKERS, knit_words=["ring", "gizmo"]).select("object_id", "lane")


FOCUS_BLOCKERS = {"dress": ["anvil", "rod"], "top": ["gear"]}


@query("flt_focus_skew", f"""SELECT q.query_id, p.object_id FROM queries q JOIN products p ON p.brand = concat('Brand#', CAST(1 + q.query_id % 25 AS VARCHAR))
    WHERE q.avoid = '' OR (p.category IN ('dress', 'top') AND NOT (category = 'dress' AND regexp_matches(title, {starts(FOCUS_BLOCKERS['dress'])})) AND NOT (category = 'top' AND regexp_matches(title, {starts(FOCUS_BLOCKERS['top'])})))""")
def _(e):
    q = e.queries.select("query_id", F.concat(F.lit("Brand#"), (C("query_id") % 25 + 1).cast("string")).alias("brand"),
                         F.when(C("avoid") == "", F.array().cast("array<string>")).otherwise(text.lit_array(["Dress", " top"])).alias("focus"))
    # a focus decides about a product whoever asks, so rules run once per product and focus; lists of ids meet it
    asked = e.products.select("object_id", "brand", "category", "title").crossJoin(F.broadcast(q.select("focus").distinct()))
    kept = filters.focus_skew(asked, C("focus"), FOCUS_BLOCKERS).select("object_id", "brand", "focus")
    asking = q.groupBy("brand", "focus", (C("query_id") % 64).alias("lane")).agg(F.collect_list("query_id").alias("query_ids"))
    return kept.join(broadcast_measured(asking), ["brand", "focus"]).select(F.explode("query_ids").alias("query_id"), "object_id")


DISLIKED = """d AS (SELECT s.user_token, p.brand, p.category FROM signals s JOIN products p USING (object_id) WHERE s.kind = 'dislike'),
    b AS (SELECT user_token, brand FROM d GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT user_token, category FROM d GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("flt_disliked", f"""WITH {DISLIKED} SELECT s.event_id, s.user_token FROM signals s JOIN products p USING (object_id)
    WHERE s.kind = 'impression' AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_token = s.user_token AND b.brand = p.brand)
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_token = s.user_token AND k.category = p.category)""")
def _(e):
    s = e.signals.join(e.products.select("object_id", "brand", "category"), "object_id")
    d = s.where("kind = 'dislike'")
    brands = d.groupBy("user_token", "brand").count().where("count >= 2").drop("count")
    cats = d.groupBy("user_token", "category").count().where("count >= 3").drop("count")
    return filters.disliked(s.where("kind = 'impression'"), brands, cats).select("event_id", "user_token")


ALLOW = {"dress": ["rod", "ring"], "top": ["gear", "plate", "bolt"], "shoes": vocab.INDEX_TITLE_ALLOW["shoes"]}
BLOCK = {"dress": ["ring"], "bag": ["anvil"]}
ALLOW_SQL = ("(category NOT IN (" + in_list(ALLOW) + ") OR " + " OR ".join(f"(category = '{c}' AND regexp_matches(title, {starts(w)}))" for c, w in ALLOW.items()) + ") AND NOT ("
             + " OR ".join(f"(category = '{c}' AND regexp_matches(title, {starts(w)}))" for c, w in BLOCK.items()) + ")")


@query("flt_title_allow_block", IDS + ALLOW_SQL)
def _(e):
    return filters.title_allow_block(e.products, ALLOW, BLOCK).select("object_id")


@query("flt_board_relevant", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(concat(source, ' ', text)), {rx([*vocab.BOARD_WORDS, "thand"])})")
def _(e):
    return filters.board_relevant(e.table("documents"), "source", "text", words=[*vocab.BOARD_WORDS, "thand"]).select("doc_id")


@query("flt_pin_nonclothing", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), {rx([*vocab.NON_CLOTHING_WORDS, "handthat", "eauxre"])})")
def _(e):
    return filters.pin_nonclothing(e.table("documents"), "text", words=[*vocab.NON_CLOTHING_WORDS, "handthat", "eauxre"]).select("doc_id")


SHOP_RULES = [
    ("hot-list", ["dress", "top"], [(True, "t", r"\b(hot|red)\b"), (False, "m", r"\bpromo\b"), (False, "t", r"\brings?\b")]),
    ("plain-metal", [], [(True, "t|m", r"\b(anvil|economy)\b"), (True, "c?", r"red"), (True, "!c", r"\b(cold|old|new)\b"), (False, "tcmd", r"\bsize\s*1\d\b")]),
    ("small-things", ["bag"], [(True, "td", r"\bsmall\b"), (False, "tc", r"\bblue\b")]),
    *vocab.EDIT_RULES,
]
#: the edits' brand policies, and some over the brands of the catalogue
SHOP_POLICIES = vocab.EDIT_POLICIES | {
    "hot-list": {"accept": ["Brand#1"], "exclude": ["p-7", "p-11", "p-300"], "caps": {"Brand#1": 10, "Brand#2": 2}, "first": ["brand#3"]},
    "plain-metal": {"only": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#11"], "caps": {"Brand#11": 3}, "first_title": r"\bhot\b"},
}


def edit_sql(categories, tests, policy) -> str:
    parts = [f"category IN ({in_list(categories)})"] if categories else ["true"]
    required = ["true"]
    if "only" in policy:
        parts.append(f"brand IN ({in_list(policy['only'])})")
    if "exclude" in policy:
        parts.append(f"object_id NOT IN ({in_list(policy['exclude'])})")
    for must, field, pattern in tests:
        if field == "c?":
            hit, gate = f"regexp_matches(c, {quoted(pattern)})", "c = ''"
        elif field == "!c":
            hit, gate = f"regexp_matches(t, {quoted(pattern)})", "c <> ''"
        elif "|" in field:
            hit, gate = "(" + " OR ".join(f"regexp_matches({f}, {quoted(pattern)})" for f in field.split("|")) + ")", None
        else:
            hit, gate = f"regexp_matches(concat_ws(' ', {', '.join(field)}), {quoted(pattern)})", None
        test = hit if must else f"NOT {hit}"
        (required if must else parts).append(f"({gate} OR {test})" if gate else test)
    accept = f" OR lower(brand) IN ({in_list([x.lower() for x in policy['accept']])})" if "accept" in policy else ""
    return " AND ".join(parts) + f" AND (({' AND '.join(required)}){accept})"


def case_sql(column: str, other: str) -> str:
    whens = [f"WHEN edit = '{slug}' AND lower(brand) = {quoted(b.lower())} THEN {n}" for slug, p in SHOP_POLICIES.items() for b, n in p.get("caps", {}).items()]
    if column == "first":
        whens = [f"WHEN edit = '{slug}' AND lower(brand) IN ({in_list([x.lower() for x in p['first']])}) THEN true" for slug, p in SHOP_POLICIES.items() if "first" in p]
        whens += [f"WHEN edit = '{slug}' AND regexp_matches(t, {quoted(p['first_title'])}) THEN true" for slug, p in SHOP_POLICIES.items() if "first_title" in p]
    return f"CASE {' '.join(whens)} ELSE {other} END"


EDITS_SQL = ("pe AS (SELECT object_id, pos, title, brand, category, lower(title) AS t, trim(lower(color)) AS c, lower(material) AS m, lower(description) AS d FROM products), "
             + "ed AS (" + " UNION ALL ".join(f"SELECT *, '{slug}' AS edit FROM pe WHERE {edit_sql(cats, tests, SHOP_POLICIES.get(slug, {}))}" for slug, cats, tests in SHOP_RULES)
             + f"), edits AS (SELECT *, {case_sql('caps', '8')} AS brand_cap, {case_sql('first', 'false')} AS comes_first FROM ed)")


def shop_edits(e):
    return filters.edit_places(filters.edit_rules(e.products, SHOP_RULES, policies=SHOP_POLICIES), SHOP_POLICIES)


@query("flt_edit_rules", f"WITH {EDITS_SQL} SELECT object_id, edit, brand_cap, comes_first FROM edits")
def _(e):
    return shop_edits(e).select("object_id", "edit", "brand_cap", "comes_first")


VISION = (["top", "bottom", "dress", "jacket"], [r"\b(anvil|rod)\b", r"\bsize\s+1\d\b"])


@query("flt_vision_rules", rf"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN category NOT IN ({in_list(VISION[0])}) THEN concat('category:', category)
      WHEN regexp_matches(body, {quoted(VISION[1][0])}) THEN {quoted('excl:' + VISION[1][0])} WHEN regexp_matches(body, {quoted(VISION[1][1])}) THEN {quoted('excl:' + VISION[1][1])} ELSE 'kept' END AS reason
      FROM (SELECT category, lower(concat(title, ' ', description, ' ', color)) AS body FROM products)) GROUP BY 1""")
def _(e):
    kept, drops = filters.vision_rules(e.products, *VISION)
    return drops.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("kept")))


@query("flt_image_qc", """SELECT object_id, CASE WHEN w < 200 OR h < 200 THEN 'lowRes' WHEN w / h > 3.5 OR w / h < 1 / 3.5 THEN 'tallBanner' WHEN blur < 18 THEN 'blurry' WHEN entropy < 2.8 THEN 'flatGraphic' ELSE 'pass' END AS verdict
    FROM (SELECT object_id, CAST(size * 40 AS DOUBLE) AS w, CAST(500 + pos % 400 AS DOUBLE) AS h, price / 4 AS blur, CAST(pos % 7 AS DOUBLE) AS entropy FROM products)""")
def _(e):
    v = filters.image_verdict((C("size") * 40).cast("double"), (C("pos") % 400 + 500).cast("double"), C("price") / 4, (C("pos") % 7).cast("double"))
    return e.products.select("object_id", v.alias("verdict"))


@query("flt_exclude_ids", "SELECT object_id FROM products WHERE object_id NOT IN (SELECT object_id FROM signals WHERE kind IN ('like', 'save') AND dwell_ms > 20000)")
def _(e):
    seen = e.signals.where("kind IN ('like', 'save') AND dwell_ms > 20000")
    return filters.exclude_ids(e.products, seen, ["object_id"]).select("object_id")


@query("flt_handle_skip", f"SELECT object_id, handle FROM (SELECT object_id, concat(replace(title, ' ', '-'), CASE color WHEN 'red' THEN '-Gift-Card' WHEN 'blue' THEN '-balm' ELSE '' END) AS handle FROM products) WHERE NOT regexp_matches(lower(handle), {rx(vocab.SKIP_HANDLE_WORDS)})")
def _(e):
    h = F.concat(F.replace("title", F.lit(" "), F.lit("-")), F.when(C("color") == "red", "-Gift-Card").when(C("color") == "blue", "-balm").otherwise(""))
    return filters.handle_skip(e.products.select("object_id", h.alias("handle")))
