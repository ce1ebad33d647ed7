"""Registered queries of fusion, reranking, diversity and feed composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import vec
from modiste.functions.text import lit_array
from modiste.operators import aggregates, ranking, topk, windows
from modiste.operators.filters import avoid_keywords
from modiste.plans import profiles, retrieval
from modiste.plans.retrieval import keyword_search, with_categories
from modiste.scale import first_k, numbered
from modiste.workload.aggregates import ENGAGED, FEATURES, WSIG, clicks, features, unit_wmean
from modiste.workload.fixtures import query, r6c
from modiste.workload.filters import EDITS_SQL, shop_edits
from modiste.workload.sets import POOL_SQL, TERMS, WORDS, gate, keyword_sql
from modiste.workload.topk import CATVEC, CLUSTERED, near
from modiste.workload.windows import HITS, LISTS, lists

C = F.col
QC = ["query_id", "category"]
BANDS = "((s.price_range = 'budget' AND p.price_range = 'budget') OR (s.price_range = 'luxury' AND p.price_range IN ('luxury', 'mid')) OR (s.price_range = 'mid' AND p.price_range IN ('mid', 'budget')))"
WISH = "wish AS (SELECT query_id, price_range, concat(text, CASE WHEN avoid = '' THEN '' ELSE ' -widget' END) AS text, CASE WHEN avoid = '' THEN '' ELSE 'widget' END AS neg, text AS plain FROM queries)"


def wishes(e):
    return e.queries.select("query_id", "price_range", F.concat("text", F.when(C("avoid") == "", "").otherwise(" -widget")).alias("text"), F.array(F.lit("edgy"), F.lit("mini")).alias("boosts"))


@query("rank_keyword", f"WITH {WISH}, {keyword_sql('kw', 'wish', text='plain', k=40, neg='s.neg', cond=BANDS, boosts=chr(67) + 'AST(p.tag IN (' + chr(39) + 'edgy' + chr(39) + ', ' + chr(39) + 'mini' + chr(39) + ') AS INTEGER)')} SELECT query_id, object_id, matched, CAST(best AS BIGINT) AS best_attribute, rank FROM kw")
def _(e):
    return keyword_search(wishes(e), e.tagged, 40).select("query_id", "object_id", "matched", "best_attribute", "rank")


SUBS = """subs AS (SELECT query_id, category, sub_id, query_id * 100 + sub_id * 10 + CASE category WHEN 'dress' THEN 1 ELSE 2 END AS sid, split_part(text, ' ', sub_id) AS text FROM queries, (VALUES ('dress'), ('top')) x(category), (VALUES (1), (2)) y(sub_id))"""


@query("rank_multi_query", f"""WITH {SUBS}, {keyword_sql('kw', 'subs', keys='sid', k=12, cond='p.category = s.category')}, h AS (SELECT query_id, s.category, sub_id, object_id, rank FROM kw JOIN subs s USING (sid)),
    f AS (SELECT query_id, category, object_id, min(sub_id * 1000 + rank) AS f FROM h GROUP BY 1, 2, 3) SELECT query_id, category, object_id, row_number() OVER (PARTITION BY query_id, category ORDER BY f, object_id) AS pos FROM f""")
def _(e):
    q = e.queries.select("query_id", "text", F.explode(lit_array(["dress", "top"])).alias("category"))
    q = q.select("query_id", "category", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("sub_id")).withColumn("text", F.get(F.split("text", " "), C("sub_id") - 1))
    return retrieval.multi_query(q, e.tagged, 12)


RRF_LISTS = """l AS (SELECT user_token, kind AS list, object_id, min(r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_token, kind ORDER BY ts DESC, event_id DESC) AS r FROM signals) GROUP BY 1, 2, 3)"""


def signal_lists(e):
    r = numbered(e.signals, ["user_token", "kind"], [C("ts").desc(), C("event_id").desc()], "r")
    return r.groupBy("user_token", C("kind").alias("list"), "object_id").agg(F.min("r").alias("rank"))


def fuse_sql(weight: str, k: int, top: int) -> str:
    return (f"f AS (SELECT user_token, object_id, round(sum({weight} / (rank - 1 + {k})), 9) AS score FROM l WHERE {weight} <> 0 GROUP BY 1, 2) "
            f"SELECT user_token, rank, object_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_token ORDER BY score DESC, object_id) AS rank FROM f) WHERE rank <= {top}")


@query("rank_rrf", f"WITH {RRF_LISTS}, {fuse_sql('(CASE list WHEN ' + chr(39) + 'save' + chr(39) + ' THEN 3.0 WHEN ' + chr(39) + 'like' + chr(39) + ' THEN 1.0 WHEN ' + chr(39) + 'click' + chr(39) + ' THEN 0.5 ELSE 0.0 END)', 60, 50)}")
def _(e):
    return ranking.rrf(signal_lists(e), ["user_token"], {"save": 3, "like": 1, "click": 0.5}, 50).withColumn("score", F.round("score", 6))


@query("rank_reciprocal_merge", f"WITH {RRF_LISTS}, {fuse_sql('1.0', 1, 40)}")
def _(e):
    return ranking.reciprocal_merge(signal_lists(e), ["user_token"], 40).withColumn("score", F.round("score", 6))


TASTE = "tastes AS (SELECT object_id, list_reverse(vec[1:32]) || vec[33:64] AS vec FROM vectors WHERE vec_id % 3 = 0)"


def tastes(e):
    return e.vectors.where("vec_id % 3 = 0").select("object_id", F.concat(F.reverse(F.slice("vec", 1, 32)), F.slice("vec", 33, 32)).alias("vec"))


@query("rank_hybrid", f"""WITH {TASTE}, {near('a', 'queries', 'vectors', 200, floor=0.05)}, {near('b', 'queries', 'vibes', 200, floor=0.05)}, {near('t', 'queries', 'tastes', 200, floor=0.05)}, {keyword_sql('kw', 'queries', group='category', k=40)},
    u AS (SELECT query_id, object_id, 0 AS no, rank FROM a UNION ALL SELECT query_id, object_id, 1, rank FROM b UNION ALL SELECT query_id, object_id, 2, rank FROM t),
    fi AS (SELECT query_id, object_id, min(no * 1000000 + rank) AS f FROM u GROUP BY 1, 2), g AS (SELECT query_id, category, object_id, no, row_number() OVER (PARTITION BY query_id, category, no ORDER BY f, object_id) AS rank FROM u JOIN fi USING (query_id, object_id) JOIN products USING (object_id)),
    l AS (SELECT query_id, category, object_id, rank, CASE no WHEN 0 THEN 3.0 ELSE 1.0 END AS w FROM g WHERE rank <= 40 UNION ALL SELECT query_id, category, object_id, rank, 0.5 FROM kw),
    f AS (SELECT query_id, category, object_id, round(sum(w / (rank + 59)), 9) AS score FROM l GROUP BY 1, 2, 3), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, object_id) AS rank FROM f) WHERE rank <= 20)
    SELECT query_id, tp.category, rank, object_id, round(score, 6) AS score, title, brand, price FROM tp JOIN products p USING (object_id) WHERE starts_with(image_url, 'http') AND NOT contains(image_url, 'placeholder')""")
def _(e):
    out = retrieval.hybrid(e.queries, e.tagged, e.vectors, e.vibes, 20, 0.05, taste=tastes(e))
    return out.withColumn("score", F.round("score", 6))


@query("rank_two_stage")
def _(e):
    center = profiles.session_centroid(e.signals, e.vectors)
    out = retrieval.two_stage(e.queries, e.phrases, e.tagged, e.vectors, e.vibes, center, features(e), per_category=20, gate_floor=0.05, rerank_floor=0.0, phrase_threshold=0.15, align=(0.0, 0.10), taste=tastes(e))
    return out


AFF = """mx AS (SELECT *, max(weight) OVER (PARTITION BY user_token, feature) AS mw FROM features),
    aff AS (SELECT c.*, least(1.0, 0.5 * coalesce(b.weight / b.mw, 0.0) + 0.3 * coalesce(k.weight / k.mw, 0.0) + 0.2 * coalesce(r.weight / r.mw, 0.0)) AS click_affinity FROM {src} c
      LEFT JOIN mx b ON b.user_token = c.user_token AND b.feature = 'brand' AND b.value = lower(c.brand) LEFT JOIN mx k ON k.user_token = c.user_token AND k.feature = 'color' AND k.value = lower(c.color)
      LEFT JOIN mx r ON r.user_token = c.user_token AND r.feature = 'retailer' AND r.value = lower(c.retailer))"""


@query("rank_click_affinity", f"WITH {FEATURES}, cand AS (SELECT s.event_id, s.user_token, p.brand, p.color, p.retailer FROM signals s JOIN products p USING (object_id) WHERE kind = 'impression'), {AFF.format(src='cand')} SELECT event_id, round(click_affinity, 6) AS click_affinity FROM aff")
def _(e):
    cand = e.signals.where("kind = 'impression'").join(e.products.select("object_id", "brand", "color", "retailer"), "object_id")
    return ranking.click_affinity(cand, features(e)).select("event_id", F.round("click_affinity", 6).alias("click_affinity"))


RAW_UNIT = "SELECT user_token, i, m / sqrt(sum(m * m) OVER (PARTITION BY user_token)) AS x FROM (SELECT user_token, i, sum(x * w) / sum(w) AS m FROM (SELECT user_token, w, unnest(vec) AS x, unnest(range(64)) AS i FROM {src}) GROUP BY 1, 2)"
CENTER = f"{WSIG}, wj AS (SELECT user_token, w, vec FROM w JOIN vectors USING (object_id)), center AS (SELECT user_token, list(x ORDER BY i) AS vec FROM ({RAW_UNIT.format(src='wj')}) GROUP BY 1)"


def center(e):
    w = aggregates.signal_weights(e.signals, {"save": 2.0, "like": 1.0})
    return aggregates.weighted_centroid(w, e.vectors, ["user_token"])


def near_pool(e):
    """Thirty nearest items of every (query, category) with a keyword-rank fraction."""
    n = topk.nearest(e.queries, with_categories(e.vectors, e.products), 30, None, group="category")
    return retrieval.ranking_fraction(n)


NEARPOOL = f"{CATVEC}, {near('np', 'queries', 'catvec', 30, group='category')}, npool AS (SELECT query_id, category, object_id, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE 1 - (rank - 1) / (count(*) OVER w - 1) END AS kw_fraction FROM np WINDOW w AS (PARTITION BY query_id, category))"
BONUS = "pa AS (SELECT query_id, count(*) AS n FROM phrases GROUP BY 1), pb AS (SELECT p.query_id, v.object_id, count(*) AS h FROM phrases p, vectors v WHERE round(list_cosine_similarity(p.vec, v.vec), 6) >= 0.15 GROUP BY 1, 2)"


@query("rank_phrase_bonus", f"WITH {NEARPOOL}, {BONUS} SELECT query_id, object_id, round(coalesce(0.18 * h / n, 0.0), 6) AS phrase_bonus FROM npool LEFT JOIN pb USING (query_id, object_id) LEFT JOIN pa USING (query_id)")
def _(e):
    return ranking.phrase_bonus(near_pool(e), e.phrases, e.vectors, 0.15).select("query_id", "object_id", F.round("phrase_bonus", 6).alias("phrase_bonus"))


POLICY = "CAST(CASE WHEN al IS NULL THEN 0.0 WHEN al < 0.0 THEN 0.05 WHEN al < 0.1 THEN 0.15 ELSE 0.25 END AS DOUBLE)"


@query("rank_weight_policy", f"""WITH {NEARPOOL}, {CENTER}, s AS (SELECT query_id, category, avg(CASE WHEN b.object_id IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM npool LEFT JOIN vibes b USING (object_id) GROUP BY 1, 2),
    a AS (SELECT query_id, list_cosine_similarity(c.vec, q.vec) AS al FROM queries q LEFT JOIN center c USING (user_token)), x AS (SELECT query_id, category, share, {POLICY} AS wc FROM s JOIN a USING (query_id))
    SELECT query_id, category, round(CASE WHEN share >= 0.5 THEN (1 - wc) * 0.8 ELSE 1 - wc END, 6) AS w_visual, round(CASE WHEN share >= 0.5 THEN (1 - wc) * 0.2 ELSE 0.0 END, 6) AS w_vibe, round(wc, 6) AS w_centroid FROM x""")
def _(e):
    pool = near_pool(e).join(e.vibes.select("object_id", F.lit(1.0).alias("v")), "object_id", "left").groupBy(*QC).agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("share"))
    q = e.queries.join(center(e).select("user_token", C("vec").alias("c")), "user_token", "left").select("query_id", vec.cosine(C("c"), C("vec")).alias("al"))
    names = ("w_visual", "w_vibe", "w_centroid")
    return pool.join(q, "query_id").select(*QC, *[F.round(c, 6).alias(n) for n, c in zip(names, ranking.weight_policy(C("al"), C("share"), (0.0, 0.1)))])


def norm_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 0.0 WHEN count({c}) OVER g >= 30 THEN CASE WHEN stddev_pop({c}) OVER g < 1e-9 THEN 0.0 ELSE ({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g END WHEN count({c}) OVER g = 1 THEN 1.0 "
            f"ELSE (row_number() OVER (PARTITION BY query_id, category ORDER BY {c} NULLS LAST, object_id) - 1) / (count({c}) OVER g - 1) END AS n_{c}")


RERANK = f"""{NEARPOOL}, {CENTER}, {FEATURES}, {BONUS},
    r0 AS (SELECT n.query_id, n.category, n.object_id, n.kw_fraction, q.user_token, p.brand, p.color, p.retailer, list_cosine_similarity(c.vec, q.vec) AS al, round(list_cosine_similarity(q.vec, v.vec), 9) AS vis, round(list_cosine_similarity(q.vec, b.vec), 9) AS vib,
      round(list_cosine_similarity(c.vec, v.vec), 9) AS cent FROM npool n JOIN queries q USING (query_id) JOIN products p USING (object_id) LEFT JOIN center c USING (user_token) LEFT JOIN vectors v USING (object_id) LEFT JOIN vibes b USING (object_id)),
    r1 AS (SELECT *, avg(CASE WHEN vib IS NULL THEN 0.0 ELSE 1.0 END) OVER g AS share, {norm_sql('vis')}, {norm_sql('vib')}, {norm_sql('cent')} FROM r0 WHERE vis IS NULL OR vis >= 0.0 WINDOW g AS (PARTITION BY query_id, category)),
    r2 AS (SELECT *, {POLICY} AS wc FROM r1), {AFF.format(src='r2')},
    scored AS (SELECT query_id, category, object_id, round(round((CASE WHEN share >= 0.5 THEN (1 - wc) * 0.8 ELSE 1 - wc END) * n_vis + (CASE WHEN share >= 0.5 THEN (1 - wc) * 0.2 ELSE 0.0 END) * n_vib + wc * n_cent + 0.10 * click_affinity + 0.05 * kw_fraction
      + coalesce(0.18 * h / n, 0.0), 9), 6) AS score FROM aff LEFT JOIN pb USING (query_id, object_id) LEFT JOIN pa USING (query_id))"""


def reranked(e, with_vectors=True):
    return ranking.rerank(near_pool(e), e.queries, e.products, e.vectors, e.vibes, center(e), features(e), e.phrases, 0.0, 0.15, (0.0, 0.1), with_vectors)


@query("rank_rerank_score", f"WITH {RERANK} SELECT query_id, category, object_id, score + 0.0 AS score FROM scored")
def _(e):
    return reranked(e, False).select("query_id", "category", "object_id", r6c(C("score")).alias("score"))


MMR = RERANK.replace("round(round((CASE WHEN share", "round((CASE WHEN share").replace(", 9), 6) AS score", ", 9) AS score")


@query("rank_mmr", f"""WITH RECURSIVE {MMR}, nr AS (SELECT s.query_id, s.category, s.object_id, s.score, trim(lower(coalesce(brand, ''))) AS b, vec, row_number() OVER (PARTITION BY s.query_id, s.category ORDER BY s.score DESC, s.object_id) AS i
      FROM scored s JOIN products USING (object_id) LEFT JOIN vectors USING (object_id)),
    sims AS (SELECT a.query_id, a.category, a.i, list(coalesce(list_cosine_similarity(a.vec, c.vec), 0.0) ORDER BY c.i) AS v FROM nr a JOIN nr c USING (query_id, category) GROUP BY 1, 2, 3),
    it AS (SELECT query_id, category, list(struct_pack(i := i, id := object_id, s := score, b := b, m := CAST(0 AS DOUBLE), p := CAST(0 AS DOUBLE), v := v) ORDER BY i) AS items FROM nr JOIN sims USING (query_id, category, i) GROUP BY 1, 2),
    mw AS (SELECT query_id, category, items, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS DOUBLE) AS score, CAST(0 AS BIGINT) AS pos FROM it UNION ALL
      SELECT query_id, category, list_transform(list_filter(items, lambda x: x.i <> g.i), lambda x: struct_pack(i := x.i, id := x.id, s := x.s, b := x.b, m := greatest(x.m, x.v[g.i]), p := CASE WHEN g.b <> '' AND x.b = g.b THEN CAST(0.15 AS DOUBLE) ELSE x.p END, v := x.v)), g.id, g.s, pos + 1
      FROM (SELECT *, items[list_position(list_transform(items, lambda x: round(x.s - 0.3 * x.m - x.p, 9)), list_max(list_transform(items, lambda x: round(x.s - 0.3 * x.m - x.p, 9))))] AS g FROM mw WHERE pos < 10 AND len(items) > 0))
    SELECT query_id, category, id AS object_id, round(score, 6) AS score, pos AS mmr_pos FROM mw WHERE pos > 0""")
def _(e):
    return ranking.mmr(reranked(e), 10).withColumn("score", F.round("score", 6))


@query("rank_quality_gate", f"""WITH vibevec AS (SELECT v.object_id, category, vec FROM vibes v JOIN products USING (object_id)), {near('n', 'queries', 'vibevec', 10, group='category')},
    bad AS (SELECT n.query_id, n.category FROM n JOIN queries q USING (query_id) JOIN vectors v USING (object_id) WHERE n.rank = 1 AND list_cosine_similarity(q.vec, v.vec) < 0.02)
    SELECT query_id, category, rank, object_id FROM n WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.query_id = n.query_id AND bad.category = n.category)""")
def _(e):
    n = topk.nearest(e.queries, with_categories(e.vibes, e.products), 10, None, group="category")
    return ranking.quality_gate(n, e.queries, e.vectors, 0.02).select("query_id", "category", "rank", "object_id")


# ── session ranking ───────────────────────────────────────────────────────────
SIG20 = """s20 AS (SELECT user_token, kind, object_id, (CASE kind WHEN 'save' THEN 2.0 ELSE 1.0 END) * pow(0.85, rk - 1) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_token, kind ORDER BY ts DESC, event_id DESC) AS rk FROM signals WHERE kind IN ('save', 'like', 'dislike')) WHERE rk <= 20)"""


def _unit(src: str) -> str:
    return f"SELECT user_token, i, m / sqrt(sum(m * m) OVER (PARTITION BY user_token)) AS x FROM ({src})"


CENTERS = f"""{SIG20}, sp AS (SELECT user_token, w, vec FROM s20 JOIN vectors USING (object_id) WHERE kind <> 'dislike'), sn AS (SELECT user_token, w, vec FROM s20 JOIN vectors USING (object_id) WHERE kind = 'dislike'),
    cp AS ({RAW_UNIT.format(src='sp')}), cn AS ({RAW_UNIT.format(src='sn')}),
    c1 AS ({_unit('SELECT user_token, i, cp.x - 0.4 * coalesce(cn.x, 0) AS m FROM cp LEFT JOIN cn USING (user_token, i)')}),
    tv AS (SELECT concat('u-', CAST(vec_id AS VARCHAR)) AS user_token, vec AS tvec FROM units WHERE label < 5), te AS (SELECT user_token, unnest(tvec) AS x, unnest(range(64)) AS i FROM tv),
    c2 AS ({_unit('SELECT user_token, i, CASE WHEN te.x IS NULL THEN c1.x WHEN c1.x IS NULL THEN te.x ELSE 0.7 * c1.x + 0.3 * te.x END AS m FROM c1 FULL JOIN te USING (user_token, i)')}),
    pv AS (SELECT concat('u-', CAST(vec_id AS VARCHAR)) AS user_token, unnest(list_reverse(vec)) AS x, unnest(range(64)) AS i FROM units),
    c3 AS ({_unit('SELECT user_token, i, CASE WHEN pv.x IS NULL THEN c2.x WHEN c2.x IS NULL THEN pv.x ELSE 0.6 * c2.x + 0.4 * pv.x END AS m FROM c2 FULL JOIN pv USING (user_token, i)')}),
    sess AS (SELECT user_token, list(x ORDER BY i) AS vec FROM c3 GROUP BY 1)"""
EVERY = "ev AS (SELECT user_token, object_id, round(list_cosine_similarity(s.vec, v.vec), 6) + 0.0 AS score FROM sess s, vectors v)"
SESSION = f"{CENTERS}, {near('sn0', 'sess', 'vectors', 40, 'user_token')}"
AXP = f"""ap AS (SELECT user_token, {", ".join(f"sum(w * {a}) / sum(w) AS p_{a}" for a in vocab.AXES)} FROM s20 JOIN axes USING (object_id) WHERE kind <> 'dislike' GROUP BY 1)"""
SHIFT = {"edge": 0.35, "drape": -0.2}


def user_vectors(e):
    t = e.vectors.where("label < 5").select(F.concat(F.lit("u-"), C("vec_id").cast("string")).alias("user_token"), vec.normalize(C("vec")).alias("vec"))
    p = e.vectors.select(F.concat(F.lit("u-"), C("vec_id").cast("string")).alias("user_token"), F.reverse(vec.normalize(C("vec"))).alias("vec"))
    return t, p


def ax(a: str) -> str:
    return f"least(1.0, greatest(0.0, coalesce(p_{a}, 0.5) + {SHIFT[a]}))" if a in SHIFT else f"p_{a}"


@query("rank_session_centroid", f"""WITH {CENTERS}, {EVERY}, {AXP}, ap2 AS (SELECT user_token, {", ".join(f"{ax(a)} AS q_{a}" for a in vocab.AXES)} FROM ap),
    f AS (SELECT s.user_token, s.object_id, round(0.7 * score + 0.3 * CASE WHEN q_edge IS NULL THEN 0.5 ELSE ({" + ".join(f"1 - abs(q_{a} - {a})" for a in vocab.AXES)}) / 5 END, 9) AS fused FROM ev s JOIN axes USING (object_id) LEFT JOIN ap2 USING (user_token)
      WHERE NOT EXISTS (SELECT 1 FROM s20 x WHERE x.kind <> 'dislike' AND x.user_token = s.user_token AND x.object_id = s.object_id))
    SELECT user_token, object_id, fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_token ORDER BY fused DESC, object_id) AS rank FROM f) WHERE rank <= 40""")
def _(e):
    t, p = user_vectors(e)
    return profiles.rank_session(e.signals, e.vectors, e.axes, t, p, total_k=40, deltas=SHIFT)


@query("rank_axis_match", f"""WITH {SIG20}, {AXP} SELECT s.event_id, round(CASE WHEN p_edge IS NULL OR x.edge IS NULL THEN 0.5 ELSE ({" + ".join(f"1 - abs(p_{a} - x.{a})" for a in vocab.AXES)}) / 5 END, 6) AS match,
    greatest(0.0, p_edge - 0.25) <= x.edge AND x.edge <= least(1.0, p_edge + 0.25) AS in_band FROM signals s LEFT JOIN ap USING (user_token) LEFT JOIN axes x USING (object_id) WHERE kind = 'impression'""")
def _(e):
    w = aggregates.signal_weights(e.signals, profiles.SIGNAL_BASE, limit=20)
    prof = aggregates.axis_profile(w, e.axes, ["user_token"]).select("user_token", *[C(a).alias(f"p_{a}") for a in vocab.AXES])
    j = e.signals.where("kind = 'impression'").join(prof, "user_token", "left").join(e.axes, "object_id", "left")
    m = ranking.axis_match({a: C(f"p_{a}") for a in vocab.AXES}, {a: C(a) for a in vocab.AXES})
    lo, hi = ranking.axis_filter_band(C("p_edge"))
    return j.select("event_id", F.round(m, 6).alias("match"), C("edge").between(lo, hi).alias("in_band"))


# ── cards ─────────────────────────────────────────────────────────────────────
def cards(e):
    s = e.signals.where("kind = 'impression'").join(e.products.select("object_id", "brand", "category", "color", "price_range", "size"), "object_id")
    return s.select("user_token", C("session_id").alias("card_id"), "object_id", "brand", "category", "color", "price_range", F.lit("mid").alias("aesthetic_price"), (C("size") <= 3).alias("fresh"))


def card_scores(e):
    s = clicks(e)
    hits = windows.weighted_recency_hits(s, ["brand", "color", "category"])
    d = e.signals.where("kind = 'dislike'").join(e.products.select("object_id", F.lower("brand").alias("brand"), F.lower("color").alias("color"), "category"), "object_id")
    dis = d.select("user_token", "brand", "color", "category").unpivot(["user_token"], ["brand", "color", "category"], "feature", "value").where("value <> ''").groupBy("user_token", "feature", "value").agg(F.count(F.lit(1)).alias("hits"))
    history = s.groupBy("user_token").agg(F.count(F.lit(1)).alias("n_clicks"))
    mult = aggregates.session_engagement(e.signals, ["user_token"]).select("user_token", "multiplier")
    recent = profiles.recent_n(s, 10).select("user_token", "category")
    return ranking.card_score(cards(e), hits, dis, history, mult, e.signals.where("kind = 'like'"), recent)


CARDS = f"""{HITS}, dk AS (SELECT s.user_token, lower(brand) AS brand, lower(color) AS color, category FROM signals s JOIN products USING (object_id) WHERE kind = 'dislike'),
    dis AS (SELECT user_token, f, v, count(*) AS n FROM (SELECT user_token, 'brand' AS f, brand AS v FROM dk UNION ALL SELECT user_token, 'color', color FROM dk UNION ALL SELECT user_token, 'category', category FROM dk) WHERE v <> '' GROUP BY 1, 2, 3),
    hist AS (SELECT user_token, count(*) AS nc FROM signals WHERE kind = 'click' GROUP BY 1), eng AS (SELECT user_token, 0.70 + 0.65 * avg(CASE WHEN dwell_ms <= 500 THEN 0.0 WHEN dwell_ms >= 8000 THEN 1.0 ELSE ln(dwell_ms / 500) / ln(16.0) END) AS mult FROM signals GROUP BY 1),
    lk AS (SELECT DISTINCT user_token, object_id FROM signals WHERE kind = 'like'), rc AS (SELECT DISTINCT user_token, category FROM (SELECT s.user_token, category, row_number() OVER (PARTITION BY s.user_token ORDER BY ts DESC, event_id DESC) AS rn FROM signals s JOIN products USING (object_id) WHERE kind = 'click') WHERE rn <= 10),
    it AS (SELECT s.user_token, s.session_id AS card_id, CASE WHEN coalesce(nc, 0) = 0 THEN 0.5 ELSE least(0.98, 0.20 + coalesce(hc.hits, 0) * 0.38) END AS cat,
      CASE WHEN coalesce(nc, 0) = 0 THEN 0.30 WHEN coalesce(hb.hits, 0) = 0 THEN 0.40 ELSE least(0.98, 0.75 + (hb.hits - 1) * 0.12) END AS br, CASE WHEN color = '' OR coalesce(nc, 0) = 0 THEN 0.50 ELSE least(0.95, 0.30 + coalesce(hk.hits, 0) * 0.32) END AS co,
      CASE p.price_range WHEN 'mid' THEN 1.0 ELSE 0.40 END AS pr, least(0.45, coalesce(dc.n, 0) * 0.16) AS pc, CASE WHEN db.n IS NULL THEN 0.0 ELSE least(0.55, 0.30 + (db.n - 1) * 0.15) END AS pb, least(0.40, coalesce(dd.n, 0) * 0.14) AS pk,
      CASE WHEN rc.category IS NULL THEN 1.0 ELSE 0.0 END AS nv, lk.object_id IS NOT NULL AS liked, size <= 3 AS fresh, mult
      FROM signals s JOIN products p USING (object_id) LEFT JOIN hist ON hist.user_token = s.user_token LEFT JOIN eng ON eng.user_token = s.user_token LEFT JOIN lk ON lk.user_token = s.user_token AND lk.object_id = s.object_id
      LEFT JOIN rc ON rc.user_token = s.user_token AND rc.category = p.category LEFT JOIN hits hc ON hc.user_token = s.user_token AND hc.feature = 'category' AND hc.value = p.category
      LEFT JOIN hits hb ON hb.user_token = s.user_token AND hb.feature = 'brand' AND hb.value = lower(p.brand) LEFT JOIN hits hk ON hk.user_token = s.user_token AND hk.feature = 'color' AND hk.value = p.color
      LEFT JOIN dis dc ON dc.user_token = s.user_token AND dc.f = 'category' AND dc.v = p.category LEFT JOIN dis db ON db.user_token = s.user_token AND db.f = 'brand' AND db.v = lower(p.brand) LEFT JOIN dis dd ON dd.user_token = s.user_token AND dd.f = 'color' AND dd.v = p.color
      WHERE s.kind = 'impression'),
    g AS (SELECT user_token, card_id, avg(cat) AS cat, avg(br) AS br, avg(co) AS co, avg(pr) AS pr, max(pc) AS pc, max(pb) AS pb, max(pk) AS pk, avg(nv) AS nv, bool_or(liked) AS liked, bool_or(fresh) AS fresh, any_value(mult) AS mult FROM it GROUP BY 1, 2),
    cs AS (SELECT user_token, card_id, fresh, least(0.97, greatest(0.02, (cat * 0.38 + br * 0.22 + co * 0.20 + pr * 0.15 + 0.05) * mult + CASE WHEN liked THEN 0.10 ELSE 0 END - pc * 0.5 - pk * 0.3)) AS pl,
      least(0.90, greatest(0.05, CASE WHEN nv < 0.25 THEN 0.15 + nv * 1.2 WHEN nv < 0.65 THEN 0.5 + (nv - 0.25) * 0.6 ELSE 0.5 - (nv - 0.65) * 0.8 END)) AS pm,
      least(0.95, greatest(0.02, cat * 0.35 + br * 0.35 + pr * 0.20 + 0.10 - pb * 0.55 - pc * 0.35)) AS pk FROM g)"""


@query("rank_card_score", f"WITH {CARDS.replace('hk AS (SELECT s.user_token', 'hk AS (SELECT s.user_token')} SELECT user_token, card_id, round(round(pl * 0.55 + pm * 0.15 + pk * 0.30 + CASE WHEN fresh THEN 0.06 ELSE 0 END, 9), 6) AS score, round(pl, 6) AS p_like, round(pm, 6) AS p_comment, round(pk, 6) AS p_click FROM cs")
def _(e):
    return card_scores(e).select("user_token", "card_id", *[F.round(c, 6).alias(c) for c in ("score", "p_like", "p_comment", "p_click")])


@query("rank_wildcards", f"""WITH RECURSIVE {CARDS}, cq AS (SELECT user_token, card_id, round(pl * 0.55 + pm * 0.15 + pk * 0.30 + CASE WHEN fresh THEN 0.06 ELSE 0 END, 9) AS score, round(pm, 9) AS p_comment FROM cs),
    ex AS (SELECT user_token, round(CASE WHEN n < 3 THEN 0.75 ELSE least(0.75, greatest(0.15, 0.75 - (0.60 * m + 0.25 * l / n - 0.35 * least(1.0, d / n)))) END, 9) AS explore FROM ({ENGAGED.replace('user_token, session_id', 'user_token').replace('GROUP BY 1, 2', 'GROUP BY 1')})),
    st AS (SELECT user_token, CAST(least(9, greatest(3, floor(9 - explore * 6 + 0.5))) AS BIGINT) AS stride FROM ex),
    q0 AS (SELECT user_token, stride, list(struct_pack(c := card_id, n := p_comment) ORDER BY score DESC, card_id) AS q FROM cq JOIN st USING (user_token) GROUP BY 1, 2),
    w AS (SELECT user_token, stride, q, stride AS slot FROM q0 UNION ALL
      SELECT user_token, stride, CASE WHEN b = 1 THEN q ELSE list_concat(q[1 : slot - 1], list_concat([q[slot + b]], list_concat(q[slot : slot + b - 1], q[slot + b + 1 :]))) END, slot + stride
      FROM (SELECT *, list_position(list_transform(q[slot + 1 :], lambda x: x.n), list_max(list_transform(q[slot + 1 :], lambda x: x.n))) AS b FROM w WHERE slot < len(q))),
    l AS (SELECT user_token, max_by(q, slot) AS q FROM w GROUP BY 1) SELECT user_token, x.c AS card_id, new_pos FROM (SELECT user_token, unnest(q) AS x, unnest(generate_series(1, len(q))) AS new_pos FROM l)""")
def _(e):
    ranked = numbered(card_scores(e), ["user_token"], [C("score").desc(), "card_id"], "pos").withColumn("p_comment", F.round("p_comment", 9))
    eng = aggregates.session_engagement(e.signals, ["user_token"]).select("user_token", F.round("explore", 9).alias("explore"))
    return ranking.wildcards(ranked.join(eng, "user_token"), ["user_token"])


@query("rank_upcoming_only", f"WITH {LISTS} SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN lpos <= 12 THEN 0 ELSE 1 END, CASE WHEN lpos <= 12 THEN 0 ELSE -size END, lpos) AS new_pos FROM lists")
def _(e):
    return ranking.upcoming_only(lists(e), ["lane"], F.lit(12), "lpos", "size").select("lane", "object_id", "new_pos")


@query("rank_spread_brand", f"""WITH RECURSIVE {LISTS}, p AS (SELECT lane, CAST(floor((lpos - 1) / 384) AS BIGINT) AS page, object_id, lpos, coalesce(nullif(lower(trim(coalesce(brand, retailer, ''))), ''), '__unknown__') AS brand_key FROM lists),
    n AS (SELECT lane, page, brand_key, count(*) AS n, min(lpos) AS f FROM p GROUP BY 1, 2, 3), s0 AS (SELECT lane, page, list(struct_pack(b := brand_key, n := n) ORDER BY f) AS left_, min(f) AS start FROM n GROUP BY 1, 2),
    w AS (SELECT lane, page, left_, start, CAST([] AS VARCHAR[]) AS ring, CAST(NULL AS VARCHAR) AS took, CAST(0 AS BIGINT) AS step FROM s0 UNION ALL
      SELECT lane, page, list_filter(list_transform(left_, lambda x: struct_pack(b := x.b, n := CASE WHEN x.b = go THEN x.n - 1 ELSE x.n END)), lambda x: x.n > 0), start, list_concat(list_filter(ring, lambda x: x <> go), [go])[-4:], go, step + 1
      FROM (SELECT *, coalesce(list_filter(left_, lambda x: NOT list_contains(ring, x.b) AND x.n = list_max(list_transform(list_filter(left_, lambda y: NOT list_contains(ring, y.b)), lambda y: y.n)))[1].b,
        list_filter(ring, lambda r: list_contains(list_transform(left_, lambda y: y.b), r))[1]) AS go FROM w WHERE len(left_) > 0)),
    o AS (SELECT lane, page, took AS brand_key, start + step - 1 AS new_pos, row_number() OVER (PARTITION BY lane, page, took ORDER BY step) AS nr FROM w WHERE step > 0)
    SELECT lane, page, object_id, brand_key, new_pos FROM o JOIN (SELECT *, row_number() OVER (PARTITION BY lane, page, brand_key ORDER BY lpos) AS nr FROM p) USING (lane, page, brand_key, nr)""")
def _(e):
    return ranking.spread_brand(lists(e).withColumn("page", F.floor((C("lpos") - 1) / 384)), ["lane"], "page", pos="lpos")


@query("rank_pick_diverse", f"""WITH RECURSIVE {EDITS_SQL}, r AS (SELECT edit, object_id, coalesce(category, 'other') AS category, coalesce(brand, '') AS brand, concat(lower(brand), '|', trim(lower(title))) AS tk, brand_cap AS cap, CASE WHEN comes_first THEN 0 ELSE 1 END AS pr, pos FROM edits),
    ct AS (SELECT edit, list(category ORDER BY f, i) AS cats FROM (SELECT edit, category, min(pos) AS f, arg_min(object_id, struct_pack(a := pos, b := object_id)) AS i FROM r GROUP BY 1, 2) GROUP BY 1),
    pool AS (SELECT edit, list(struct_pack(id := object_id, c := category, b := brand, t := tk, m := cap) ORDER BY pr, object_id) AS items FROM r GROUP BY 1),
    w AS (SELECT edit, cats, items, CAST([] AS VARCHAR[]) AS brands, CAST(NULL AS VARCHAR) AS id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS idle, CAST(0 AS BIGINT) AS slot FROM ct JOIN pool USING (edit) UNION ALL
      SELECT edit, cats, CASE WHEN p IS NULL THEN items ELSE list_filter(items, lambda x: x.t <> p.t AND NOT (x.b = p.b AND len(list_filter(brands, lambda y: y = p.b)) + 1 >= x.m)) END, CASE WHEN p IS NULL THEN brands ELSE list_append(brands, p.b) END, p.id, turn + 1, CASE WHEN p IS NULL THEN idle + 1 ELSE 0 END, slot + CASE WHEN p IS NULL THEN 0 ELSE 1 END
      FROM (SELECT *, list_filter(items, lambda x: x.c = cats[turn % len(cats) + 1])[1] AS p FROM w WHERE slot < 36 AND idle < len(cats)))
    SELECT w.edit, id AS object_id, category, brand, slot FROM w JOIN r ON r.edit = w.edit AND r.object_id = id WHERE id IS NOT NULL""")
def _(e):
    return ranking.pick_diverse(shop_edits(e), ["edit"], brand_cap=C("brand_cap"), priority=C("comes_first"))


@query("rank_pick_topn_brandcap", """WITH p AS (SELECT category, brand, object_id, coalesce(price, 0) AS score, size = 50 AS keep FROM products), nk AS (SELECT category, brand, count(*) AS nk FROM p WHERE keep GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, brand, keep ORDER BY score DESC, object_id) AS rn FROM p), u AS (SELECT r.* FROM r LEFT JOIN nk USING (category, brand) WHERE keep OR rn + coalesce(nk, 0) <= 4)
    SELECT category, object_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY keep DESC, score DESC, object_id) AS slot FROM u) WHERE slot <= 36""")
def _(e):
    return ranking.pick_topn_brandcap(e.products.withColumn("score", F.coalesce("price", F.lit(0.0))), ["category"], kept=C("size") == 50).select("category", "object_id", "slot")


@query("rank_brands_by_taste", """WITH bc AS (SELECT brand AS object_id, list(m ORDER BY i) AS vec FROM (SELECT brand, i, avg(x) AS m FROM (SELECT brand, unnest(vec) AS x, unnest(range(64)) AS i FROM units JOIN products USING (object_id)) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT q.user_token, b.object_id AS brand, round((round(list_cosine_similarity(q.vec, b.vec), 6) + 0.0) * CASE WHEN b.object_id IN ('Brand#1', 'Brand#2', 'Brand#3') AND q.price_range = 'budget' THEN 0.5 ELSE 1.0 END, 9) AS score FROM queries q, bc b)
    SELECT user_token, brand, score + 0.0 AS score, row_number() OVER (PARTITION BY user_token ORDER BY score DESC, brand) AS rank FROM s""")
def _(e):
    cent = vec.mean_by(e.vectors.withColumn("vec", vec.normalize(C("vec"))).join(e.products.select("object_id", "brand"), "object_id"), ["brand"])
    ages = e.products.where(C("brand").isin("Brand#1", "Brand#2", "Brand#3")).select("brand").distinct().withColumn("preferred_ages", lit_array(["mid", "luxury"]))
    users = e.queries.select("user_token", C("price_range").alias("age_key"), "vec")
    return ranking.brands_by_taste(users, cent, ages).withColumn("score", C("score") + 0.0)


@query("rank_similar_items", f"""WITH {CLUSTERED.replace('phrase / 10.0', 'CAST(phrase AS DOUBLE) / 10')}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM f) WHERE rank <= 40),
    j AS (SELECT query_id, object_id, category, score FROM k JOIN products USING (object_id) WHERE object_id NOT IN (SELECT concat('p-', CAST(query_id + phrase AS VARCHAR)) FROM phrases ph WHERE ph.query_id = k.query_id))
    SELECT query_id, category, object_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, object_id) AS rank FROM j) WHERE rank <= 3""".replace("score >= 0.05", "score >= 0.0"))
def _(e):
    from modiste.workload.topk import clusters

    seeds = e.phrases.select("query_id", F.concat(F.lit("p-"), (C("query_id") + C("phrase")).cast("string")).alias("object_id"))
    return ranking.similar_items(clusters(e), seeds, e.vectors, e.products, 40, 3, "query_id").select("query_id", "category", "object_id", "rank")


@query("rank_diverse_brand_pull", """WITH c AS (SELECT category, brand, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS b FROM products GROUP BY 1, 2), i AS (SELECT p.category, p.object_id, b, row_number() OVER (PARTITION BY p.category, p.brand ORDER BY pos, p.object_id) AS i FROM products p JOIN c USING (category, brand) WHERE b <= 20),
    r AS (SELECT category, object_id, row_number() OVER (PARTITION BY category ORDER BY i, b) AS new_pos FROM i WHERE i <= 8) SELECT * FROM r WHERE new_pos > 48 AND new_pos <= 96""")
def _(e):
    return ranking.diverse_brand_pull(e.products, ["category"], brands=20, page=1, size=48).select("category", "object_id", "new_pos")


@query("rank_augment_pool", f"""WITH {TERMS}, {keyword_sql('kw', 'queries', k=20, need_terms=False)}, {near('sv', 'queries', 'vectors', 30, floor=0.05)}, {near('bv', 'queries', 'vibes', 20)},
    a AS (SELECT query_id, object_id, rank FROM sv WHERE object_id IN (SELECT object_id FROM products) AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = sv.query_id AND kw.object_id = sv.object_id)),
    b AS (SELECT query_id, object_id, rank FROM bv WHERE object_id IN (SELECT object_id FROM products) AND rank <= 15 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = bv.query_id AND kw.object_id = bv.object_id) AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = bv.query_id AND a.object_id = bv.object_id)),
    u AS (SELECT query_id, object_id, 0 AS s, rank FROM kw UNION ALL SELECT query_id, object_id, 1, rank FROM a UNION ALL SELECT query_id, object_id, 2, rank FROM b) SELECT query_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY s, rank, object_id) AS new_pos FROM u""")
def _(e):
    pool = keyword_search(e.queries.select("query_id", "text"), e.tagged, 20).select("query_id", "object_id", C("rank").alias("pos"))
    return ranking.augment_pool(pool, topk.nearest(e.queries, e.vectors, 30, 0.05), topk.nearest(e.queries, e.vibes, 20), e.products, ["query_id"], 15)


FRESH = "fr AS (SELECT category AS lane, object_id, row_number() OVER (PARTITION BY category ORDER BY size DESC, object_id) AS rank FROM products)"


@query("rank_insert_ahead", f"WITH {LISTS}, {FRESH}, k AS (SELECT lane, object_id, 0 AS s, lpos AS p FROM lists WHERE lpos <= 9), u AS (SELECT * FROM k UNION ALL SELECT lane, object_id, 1, rank FROM fr WHERE rank <= 40 AND (lane, object_id) NOT IN (SELECT (lane, object_id) FROM k)) SELECT lane, object_id, row_number() OVER (PARTITION BY lane ORDER BY s, p, object_id) AS new_pos FROM u")
def _(e):
    fresh = first_k(e.products.select(C("category").alias("lane"), "object_id", "size"), ["lane"], [C("size").desc(), "object_id"], 40, "rank")
    return ranking.insert_ahead(lists(e).select("lane", "object_id", "lpos"), fresh, ["lane"], F.lit(6), pos="lpos")


@query("rank_optional_words", f"WITH {keyword_sql('kw', 'queries', optional=True, k=None)}, o AS (SELECT kw.* FROM kw JOIN queries q USING (query_id) JOIN products p USING (object_id) WHERE q.avoid = '' OR NOT contains(lower(concat(p.title, ' ', p.category, ' ', p.color)), q.avoid)) SELECT query_id, object_id, matched, rank FROM (SELECT query_id, object_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM o) WHERE rank <= 60")
def _(e):
    from modiste.plans.retrieval import optional_search

    return optional_search(e.queries.select("query_id", "text", F.array("avoid").alias("avoids")), e.tagged, 60).select("query_id", "object_id", "matched", "rank")


def edits(e):
    picks = first_k(e.products.where("tag <> ''"), ["tag"], [C("size").desc(), "object_id"], 30)
    ids = picks.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("rn", "object_id"))).alias("l"))
    return ids.select(C("tag").alias("slug"), F.transform("l", lambda x: x["object_id"]).alias("product_ids"), C("tag").isin("edgy", "casual", "mini").alias("featured"))


@query("rank_edit_hydrate", "SELECT tag AS slug, pos, object_id, title, brand FROM (SELECT tag, object_id, title, brand, row_number() OVER (PARTITION BY tag ORDER BY size DESC, object_id) AS pos FROM products WHERE tag IN ('edgy', 'casual', 'mini')) WHERE pos <= 30")
def _(e):
    return ranking.edit_hydrate(edits(e), e.products, featured=True)


@query("rank_flat_chunks", """WITH r AS (SELECT brand, object_id, row_number() OVER (PARTITION BY brand ORDER BY pos) AS p, count(*) OVER (PARTITION BY brand) AS n FROM products), c AS (SELECT *, CAST(ceil(n / 6) AS BIGINT) AS k FROM r), d AS (SELECT *, least((p - 1) // k, 5) AS i FROM c)
    SELECT brand, object_id, ['dress', 'top', 'bottom', 'jacket', 'shoes', 'bag'][i + 1] AS chunk_category, p - i * k AS chunk_pos FROM d""")
def _(e):
    ranked = numbered(e.products.select("brand", "object_id", C("pos").alias("pp")), ["brand"], ["pp"], "pos")
    return ranking.flat_chunks(ranked, ["brand"]).select("brand", "object_id", "chunk_category", "chunk_pos")


@query("rank_outfit_fill", """WITH c AS (SELECT brand, category, object_id, row_number() OVER (PARTITION BY brand, category ORDER BY pos) AS rank FROM products), k AS (SELECT brand, object_id, pos AS ord, CASE WHEN size % 2 = 0 THEN 'outfit_a' ELSE 'outfit_b' END AS g FROM products WHERE size > 46),
    v AS (SELECT brand, object_id, slot, g FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ord, object_id) AS slot FROM k) WHERE slot <= 8), n AS (SELECT brand, count(*) AS n FROM v GROUP BY 1),
    p AS (SELECT c.*, row_number() OVER (PARTITION BY brand ORDER BY CASE category WHEN 'dress' THEN 1 WHEN 'top' THEN 2 WHEN 'bottom' THEN 3 WHEN 'jacket' THEN 4 WHEN 'shoes' THEN 5 ELSE 6 END, rank, object_id) AS i FROM c WHERE object_id NOT IN (SELECT object_id FROM v))
    SELECT brand, object_id, slot, g AS outfit_group FROM v UNION ALL SELECT brand, object_id, i + coalesce(n, 0), CASE WHEN i = 1 THEN 'outfit_a' ELSE 'outfit_b' END FROM p LEFT JOIN n USING (brand) WHERE i + coalesce(n, 0) <= 8""")
def _(e):
    cand = numbered(e.products.select("brand", "category", "object_id", "pos"), ["brand", "category"], ["pos"], "rank")
    picks = e.products.where("size > 46").select("brand", "object_id", C("pos").alias("ord"), F.when(C("size") % 2 == 0, "outfit_a").otherwise("outfit_b").alias("outfit_group"))
    return ranking.outfit_fill(picks, cand, ["brand"]).select("brand", "object_id", "slot", "outfit_group")
