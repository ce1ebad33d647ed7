"""Registered queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste.functions import text
from modiste.operators import joins, topk
from modiste.scale import first_k, numbered
from modiste.workload.fixtures import query, quoted, r6c

C = F.col
VALID = "starts_with(p.image_url, 'http') AND NOT contains(p.image_url, 'placeholder')"


def likes(e):
    """Ranked id lists: the liked items of each user, newest first."""
    return first_k(e.signals.where("kind = 'like'"), ["user_token"], [C("ts").desc(), C("event_id").desc()], 50, "rank").select("user_token", "rank", "object_id")


LIKES = """likes AS (SELECT user_token, rank, object_id FROM (SELECT user_token, object_id, row_number() OVER (PARTITION BY user_token ORDER BY ts DESC, event_id DESC) AS rank FROM signals WHERE kind = 'like') WHERE rank <= 50)"""


@query("join_hydrate_inner", f"WITH {LIKES} SELECT user_token, rank, l.object_id, title, brand FROM likes l JOIN products p USING (object_id) WHERE {VALID}")
def _(e):
    return joins.hydrate_inner(likes(e), e.products, ["title", "brand"])


@query("join_vectors_left", """SELECT object_id, round(v.vec[1], 6) AS visual_0, round(b.vec[64], 6) AS vibe_63 FROM products LEFT JOIN vectors v USING (object_id) LEFT JOIN vibes b USING (object_id)""")
def _(e):
    j = joins.vectors_left(e.products.select("object_id"), e.vectors, e.vibes)
    return j.select("object_id", F.round(F.get("visual", F.lit(0)), 6).alias("visual_0"), F.round(F.get("vibe", F.lit(63)), 6).alias("vibe_63"))


@query("join_fetch_ordered_left", f"WITH {LIKES} SELECT user_token, rank, object_id, round(v.vec[1], 6) AS v0, title FROM likes LEFT JOIN vectors v USING (object_id) LEFT JOIN products p USING (object_id)")
def _(e):
    j = joins.fetch_ordered_left(likes(e), e.vectors.select("object_id", "vec"), e.products.select("object_id", "title"))
    return j.select("user_token", "rank", "object_id", F.round(F.get("vec", F.lit(0)), 6).alias("v0"), "title")


@query("join_semi_filter", "SELECT object_id, title FROM products WHERE object_id IN (SELECT object_id FROM signals WHERE kind = 'save')")
def _(e):
    return joins.semi_filter(e.products, e.signals.where("kind = 'save'"), ["object_id"]).select("object_id", "title")


@query("join_anti_seen", """SELECT event_id, user_token, object_id FROM signals a WHERE kind = 'click' AND NOT EXISTS
    (SELECT 1 FROM signals b WHERE b.kind = 'impression' AND b.user_token = a.user_token AND b.object_id = a.object_id)""")
def _(e):
    return joins.anti_seen(e.signals.where("kind = 'click'"), e.signals.where("kind = 'impression'"), ["user_token", "object_id"]).select("event_id", "user_token", "object_id")


AFFINITY = """affinity AS (SELECT concat(upper(brand), '  ') AS brand, list_distinct(list(category)) AS cats, min(category) AS young FROM products WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY brand
    UNION ALL SELECT retailer, ['x'], max(category) FROM products WHERE retailer IN ('r-1', 'r-4') GROUP BY retailer)"""


def affinity(e):
    """Preferred ages per brand or retailer, derived from the catalogue (the category names stand for age keys)."""
    b = e.products.where(C("brand").isin("Brand#1", "Brand#2", "Brand#3")).groupBy("brand").agg(F.min("category").alias("young")).select(F.concat(F.upper("brand"), F.lit("  ")).alias("brand"), "young")
    r = e.products.where(C("retailer").isin("r-1", "r-4")).groupBy("retailer").agg(F.max("category").alias("young")).select(C("retailer").alias("brand"), "young")
    return b.unionByName(r).select("brand", F.array("young", F.lit("any")).alias("preferred_ages"))


@query("join_brand_dim", f"""WITH {AFFINITY}, d AS (SELECT trim(lower(brand)) AS k, young FROM affinity)
    SELECT object_id, CASE WHEN coalesce(a.young, b.young) IS NULL THEN '' ELSE concat(coalesce(a.young, b.young), '|any') END AS ages
    FROM products p LEFT JOIN d a ON a.k = lower(p.brand) LEFT JOIN d b ON b.k = lower(p.retailer)""")
def _(e):
    return joins.brand_dim(e.products, affinity(e)).select("object_id", F.coalesce(F.array_join("preferred_ages", "|"), F.lit("")).alias("ages"))


@query("join_token_theta", """WITH q AS (SELECT query_id, list_distinct(string_split(text, ' ')) AS w FROM query_log), b AS (SELECT DISTINCT concat(title, ' ', category) AS phrase FROM products)
    SELECT query_id, phrase FROM q, b WHERE len(list_intersect(w, string_split(phrase, ' '))) = len(list_distinct(string_split(phrase, ' ')))""")
def _(e):
    b = e.products.select(F.concat_ws(" ", "title", "category").alias("phrase")).distinct()
    return joins.token_theta(e.query_log, b, "text", "phrase").select("query_id", "phrase")


RULES = [
    ("rods_in_dress", r"\brod\b", r"\b(hot|cold)\b", ["dress", "top"], "shoes"),
    ("rings_anywhere", r"\brings?\b", None, ["dress", "bottom", "jacket"], "bag"),
    ("small_things", r"\b(small|new)\b", r"\bplate\b", ["dress", "top", "shoes"], None),
]
RULE_SQL = " UNION ALL ".join(
    f"SELECT object_id, category, {i} AS ord, '{n}' AS rule, '{'recategorize' if t else 'delete'}' AS action, {quoted(t) if t else 'CAST(NULL AS VARCHAR)'} AS target FROM products "
    f"WHERE category IN ({', '.join(quoted(w) for w in wrong)}) AND regexp_matches(lower(title), {quoted(p)})" + (f" AND NOT regexp_matches(lower(title), {quoted(x)})" if x else "")
    for i, (n, p, x, wrong, t) in enumerate(RULES))


@query("join_rule_theta", f"SELECT object_id, rule, action, target FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS rn FROM ({RULE_SQL})) WHERE rn = 1")
def _(e):
    return joins.rule_theta(e.products, RULES).select("object_id", "rule", "action", "target")


@query("join_cross_knn", "SELECT q.query_id, v.object_id, round(list_cosine_similarity(q.vec, v.vec), 6) + 0.0 AS score FROM queries q, vectors v WHERE round(list_cosine_similarity(q.vec, v.vec), 6) >= 0.15")
def _(e):
    return topk.scored(e.queries, e.vectors, None, 0.15)


CELLS = """cells AS (SELECT object_id, category, 'edge' AS axis, edge AS value FROM axes JOIN products USING (object_id) UNION ALL SELECT object_id, category, 'drape', drape FROM axes JOIN products USING (object_id)),
    hi AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY round(value, 9) DESC, object_id) AS rn FROM cells WHERE value >= 0.6),
    lo AS (SELECT *, row_number() OVER (PARTITION BY category, axis ORDER BY round(value, 9), object_id) AS rn FROM cells WHERE value <= 0.4)"""


@query("join_pairs", f"WITH {CELLS} SELECT category, axis, rn, hi.object_id AS high_id, lo.object_id AS low_id FROM hi JOIN lo USING (category, axis, rn) WHERE rn <= 18")
def _(e):
    cells = e.axes.select("object_id", "edge", "drape").unpivot(["object_id"], ["edge", "drape"], "axis", "value").join(e.products.select("object_id", "category"), "object_id")
    hi = first_k(cells.where("value >= 0.6"), ["category", "axis"], [F.round("value", 9).desc(), "object_id"], 18)
    lo = first_k(cells.where("value <= 0.4"), ["category", "axis"], [F.round("value", 9).asc(), "object_id"], 18)
    return joins.pairs(hi, lo)


def steer_log(e):
    return e.signals.where("kind = 'like'").select(C("event_id").alias("steer_id"), "user_token", "ts")


def outcome_log(e):
    return e.signals.where("kind <> 'like' AND kind <> 'impression'")


ASOF = """SELECT e.event_id, e.user_token, max_by(s.event_id, struct_pack(a := s.ts, b := s.event_id)) AS steer_id
    FROM signals e LEFT JOIN signals s ON s.kind = 'like' AND s.user_token = e.user_token AND s.ts <= e.ts AND e.ts - s.ts <= INTERVAL 30 MINUTE
    WHERE e.kind NOT IN ('like', 'impression') GROUP BY 1, 2"""


@query("join_asof_latest_steer", ASOF)
def _(e):
    return joins.asof_latest(outcome_log(e), steer_log(e)).select("event_id", "user_token", "steer_id")


@query("join_feedback_exclude", """WITH x AS (SELECT user_token, object_id FROM signals GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN kind = 'impression' THEN session_id END) >= 2 AND count(*) FILTER (kind = 'click') = 0)
    SELECT s.event_id, s.user_token, s.object_id FROM signals s WHERE s.kind = 'impression' AND NOT EXISTS (SELECT 1 FROM x WHERE x.user_token = s.user_token AND x.object_id = s.object_id)""")
def _(e):
    return joins.feedback_exclude(e.signals.where("kind = 'impression'"), e.signals).select("event_id", "user_token", "object_id")


def picks(e):
    """Onboarding picks: the n-th click of a user against the n-th dislike."""
    def nth(kind, name):
        return numbered(e.signals.where(C("kind") == kind), ["user_token"], ["ts", "event_id"], "rn").select("user_token", "rn", C("object_id").alias(name))

    return nth("click", "picked").join(nth("dislike", "rejected"), ["user_token", "rn"])


PICKS = """nth AS (SELECT user_token, kind, object_id, row_number() OVER (PARTITION BY user_token, kind ORDER BY ts, event_id) AS rn FROM signals WHERE kind IN ('click', 'dislike')),
    picks AS (SELECT a.user_token, a.rn, a.object_id AS picked, b.object_id AS rejected FROM nth a JOIN nth b ON a.user_token = b.user_token AND a.rn = b.rn AND a.kind = 'click' AND b.kind = 'dislike')"""


@query("join_mean_vs_label", f"""WITH {PICKS} SELECT user_token, rn, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS sim FROM picks JOIN vectors a ON a.object_id = picked JOIN vectors b ON b.object_id = rejected""")
def _(e):
    from modiste.functions import vec

    return joins.mean_vs_label(picks(e), e.vectors).select("user_token", "rn", r6c(vec.dot(C("picked_vec"), C("rejected_vec"))).alias("sim"))
