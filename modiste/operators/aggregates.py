"""Aggregations: every one is a partial `groupBy`, so a hot key costs one buffer per task, not one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import scores, text, vec
from modiste.operators.joins import seen_without_click
from modiste.scale import bounded_rows, first_k, first_per_key, numbered

C = F.col


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def facet_counts(df: DataFrame, cols: Sequence[str], max_values: int) -> DataFrame:
    """(facet, value, n) for several facets in one pass; the largest `max_values` per facet."""
    long = df.select(*[C(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "facet", "value")
    counts = long.where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return first_k(counts, ["facet"], [C("n").desc(), "value"], max_values).drop("rn")


def _good_image() -> Column:
    return C("image_url").startswith("http") & ~C("image_url").contains("placeholder")


def brand_directory(products: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Retailers, then brands that are no retailer name: count and a sample image."""
    sample = F.min_by(F.when(_good_image(), C("image_url")), F.when(_good_image(), C("pos")))
    long = products.select("pos", "image_url", F.explode(F.array(F.struct(F.lit(0).alias("o"), C("retailer").alias("name")),
                                                                 F.struct(F.lit(1).alias("o"), C("brand").alias("name")))).alias("k"))
    per = (long.select("pos", "image_url", "k.*").where((C("name") != "") & ~C("name").isin(list(skip) or [""]))
           .groupBy("name").agg(F.min("o").alias("o"), F.count_if(C("o") == 0).alias("as_shop"), F.count_if(C("o") == 1).alias("as_brand"), sample.alias("image")))
    return per.select("name", F.when(C("o") == 0, C("as_shop")).otherwise(C("as_brand")).alias("n"), "image")


def brand_best_image(products: DataFrame, blocked_title: str, clothing: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Per shop name: rows and the image with the best score (3 clothing, 2 unblocked, 1 any, 0 none), first wins ties."""
    img = F.coalesce(C("image_url").startswith("http"), F.lit(False))
    blocked = F.coalesce(C("title"), F.lit("")).rlike(blocked_title)
    score = (F.when(~img, 0).when(F.lower("category").isin(list(clothing)) & ~blocked, 3).when(~blocked, 2).otherwise(1))
    name = F.coalesce(text.filled(C("retailer")), text.filled(C("brand")))
    per = products.select(name.alias("name"), score.alias("s"), "pos", "image_url").where("name IS NOT NULL")
    best = F.max_by(F.when(C("s") > 0, C("image_url")), F.struct(C("s"), -C("pos")))
    return per.groupBy("name").agg(F.count(F.lit(1)).alias("n"), best.alias("image"))


def category_index(products: DataFrame, allow=None, block=None) -> DataFrame:
    """Per category: rows and the first image whose title fits."""
    allow, block = allow or vocab.INDEX_TITLE_ALLOW, block or vocab.INDEX_TITLE_BLOCK
    title = F.lower(C("title"))
    ok = ~C("category").isin(list(allow))
    for name, words in allow.items():
        ok = ok | ((C("category") == name) & title.rlike(text.word_starts(words)))
    for name, words in block.items():
        ok = ok & ~((C("category") == name) & title.rlike(text.word_starts(words)))
    fit = ok & C("image_url").startswith("http")
    return products.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.when(fit, C("image_url")), F.when(fit, C("pos"))).alias("image"))


def breakdowns(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dimension, value, n, null_rate) over several dimensions in one pass."""
    total = df.select(*[c.cast("string").alias(n) for n, c in dims.items()]).unpivot([], list(dims), "dimension", "value")
    counts = total.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("dimension").agg(F.sum("n").alias("__all"), F.sum(F.when(C("value").isNull(), C("n")).otherwise(0)).alias("__null"))
    return counts.join(sums, "dimension").select("dimension", "value", "n", (C("__null") / C("__all")).alias("null_rate"))


# ── vectors ───────────────────────────────────────────────────────────────────
def centroid(members: DataFrame, keys: Sequence[str], cap: int | None = 100, order: Sequence[str] = ("object_id",)) -> DataFrame:
    """Unit mean of unit vectors per key with the sample count; at most `cap` samples per key when sampling is wanted."""
    rows = members if cap is None else first_k(members, keys, list(order), cap).drop("rn")
    return vec.mean_by(rows.withColumn("vec", vec.normalize(C("vec"))), list(keys), n=F.count(F.lit(1)))


def signal_weights(signals: DataFrame, base: dict[str, float], decay: float = 0.85, user: str = "user_token", limit: int | None = None) -> DataFrame:
    """Weight base·decay^rank per (user, kind), newest first. `limit` keeps the newest rows of each list."""
    kept = signals.where(C("kind").isin(list(base)))
    order = [C("ts").desc(), C("event_id").desc()]
    ranked = numbered(kept, [user, "kind"], order, "rk") if limit is None else first_k(kept, [user, "kind"], order, limit, "rk")
    weight = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(float(v)))])[C("kind")]
    return ranked.withColumn("w", weight * F.pow(F.lit(decay), C("rk") - 1)).drop("rk")


def weighted_centroid(weighted: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = weighted.join(vectors.select("object_id", "vec"), "object_id")
    return vec.mean_by(rows, list(keys), weight="w", n=F.count(F.lit(1)))


def axis_profile(weighted: DataFrame, axes: DataFrame, keys: Sequence[str], names: Sequence[str] = tuple(vocab.AXES)) -> DataFrame:
    """Weighted mean per axis; a missing value drops out of its own axis only."""
    rows = weighted.join(axes, "object_id")
    def mean(a):
        w = F.sum(F.when(C(a).isNotNull(), C("w")))
        return F.when(w > 0, F.sum(C("w") * C(a)) / w).alias(a)

    return rows.groupBy(*keys).agg(*[mean(a) for a in names])


# ── behaviour ─────────────────────────────────────────────────────────────────
def click_affinity_features(clicks: DataFrame, as_of: Column, user: str = "user_token") -> DataFrame:
    """Recency weight per (user, feature, value) over brand, colour and retailer."""
    rows = clicks.select(user, scores.recency_weight(C("ts"), as_of).alias("w"), *[text.clean(C(c)).alias(c) for c in ("brand", "color", "retailer")])
    long = rows.unpivot([user, "w"], ["brand", "color", "retailer"], "feature", "value").where("value <> ''")
    return long.groupBy(user, "feature", "value").agg(F.sum("w").alias("weight"))


BIAS_LIMITS = {"brand": 5, "category": 4, "color": 3}


def bias_topn(signals: DataFrame, liked: Sequence[str] = ("click", "save"), disliked: Sequence[str] = ("dislike",), user: str = "user_token") -> DataFrame:
    """Most frequent liked brands/categories/colours (5/4/3) and disliked brands (≥2) and categories (≥3)."""
    side = F.when(C("kind").isin(list(liked)), "liked").when(C("kind").isin(list(disliked)), "disliked")
    long = (signals.select(user, "ts", side.alias("side"), *[F.trim(C(c)).alias(c) for c in BIAS_LIMITS]).where("side IS NOT NULL")
            .unpivot([user, "ts", "side"], list(BIAS_LIMITS), "feature", "value").where("value <> ''"))
    counts = long.groupBy(user, "side", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    top = first_k(counts.where("side = 'liked'"), [user, "feature"], [C("n").desc(), C("last").desc(), "value"], max(BIAS_LIMITS.values()))
    limit = F.create_map(*[x for k, v in BIAS_LIMITS.items() for x in (F.lit(k), F.lit(v))])[C("feature")]
    low = counts.where("side = 'disliked' AND ((feature = 'brand' AND n >= 2) OR (feature = 'category' AND n >= 3))")
    cols = [user, "side", "feature", "value", "n"]
    return top.where(C("rn") <= limit).select(*cols).unionByName(low.select(*cols))


def soft_avoids(signals: DataFrame, products: DataFrame, user: str = "user_token") -> DataFrame:
    """Attributes frequent among items shown in two sessions or more and never clicked."""
    ignored = seen_without_click(signals).join(products.select("object_id", *[F.trim(F.lower(c)).alias(c) for c in ("color", "category")], F.trim("brand").alias("brand")), "object_id")
    n = ignored.groupBy(user).agg(F.count(F.lit(1)).alias("n_items"))
    freq = (ignored.unpivot([user], ["color", "brand", "category"], "feature", "value").where("value <> '' AND NOT (feature = 'color' AND value = 'unknown')")
            .groupBy(user, "feature", "value").agg(F.count(F.lit(1)).alias("n")))
    low = F.greatest(F.lit(2), F.floor(C("n_items") * 0.3))
    need = F.when(C("feature") == "category", F.floor(C("n_items") * 0.5)).otherwise(low)
    suffix = F.when(C("feature") == "color", " colors").when(C("feature") == "brand", " brand").otherwise(" styles")
    return freq.join(n, user).where(C("n") >= need).select(user, F.concat("value", suffix).alias("avoid"), "n")


def implicit_avoids(dislikes: DataFrame, user: str = "user_token", share: float = 0.4, floor: int = 3, limit: int = 5) -> DataFrame:
    """Terms in at least max(3, ⌊0.4n⌋) of a user's n ≥ 3 dislikes; the first five by first appearance, newest dislike first."""
    terms = F.concat(F.array("category", "color"), F.coalesce(C("aesthetic_tags"), F.array().cast("array<string>")))
    n = dislikes.groupBy(user).agg(F.count(F.lit(1)).alias("n_all")).where("n_all >= 3")
    long = (dislikes.select(user, "ts", "event_id", F.posexplode(terms).alias("slot", "raw")).select(user, "ts", "event_id", "slot", text.clean(C("raw")).alias("term"))
            .where("length(term) > 2"))
    first = F.min(F.struct(-F.unix_micros("ts"), -C("event_id"), C("slot")))
    counts = long.groupBy(user, "term").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).join(n, user)
    hits = counts.where(C("n") >= F.greatest(F.lit(floor), F.floor(C("n_all") * share)))
    return first_k(hits, [user], ["first", "term"], limit).select(user, "term", "n")


def session_engagement(signals: DataFrame, keys: Sequence[str] = ("user_token", "session_id")) -> DataFrame:
    """Mean dwell score, its multiplier and the explore ratio of a session."""
    per = signals.groupBy(*keys).agg(F.avg(scores.dwell_score(C("dwell_ms"))).alias("mean_dwell"), F.count("dwell_ms").alias("n"),
                                     F.count_if(C("kind") == "like").alias("likes"), F.count_if(C("kind") == "dislike").alias("dislikes"))
    engagement = 0.60 * C("mean_dwell") + 0.25 * C("likes") / C("n") - 0.35 * F.least(F.lit(1.0), C("dislikes") / C("n"))
    ratio = F.when(C("n") < 3, F.lit(0.75)).otherwise(scores.clamp(0.75 - engagement, 0.15, 0.75))
    return per.select(*keys, "mean_dwell", (0.70 + C("mean_dwell") * 0.65).alias("multiplier"), ratio.alias("explore"))


def trend_relevance(profiles: DataFrame, trends: DataFrame, body: Column, keys: Sequence[str], considered: int = 50, top: int = 6, fallback: int = 3) -> DataFrame:
    """Trends whose words occur in the profile text, best six; none relevant: the three fastest growing.

    Only the `considered` fastest-growing trends are looked at (the feed's own limit), so they travel as a literal array."""
    rows = bounded_rows(trends.orderBy(C("mom").desc(), "keyword").limit(considered), considered).to_pylist()
    lits = F.array(*[F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(float(r["mom"])).alias("mom"), F.lit(i).alias("ord"),
                              text.lit_array([w for w in r["keyword"].lower().split() if len(w) > 3] or [""]).alias("words")) for i, r in enumerate(rows)])
    scored = F.transform(lits, lambda t: F.struct((-F.size(F.filter(t["words"], lambda w: (w != "") & F.lower(body).contains(w)))).alias("neg"),
                                                  t["ord"].alias("ord"), t["keyword"].alias("keyword")))
    hits = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, top)
    pick = F.when(F.size(hits) > 0, hits).otherwise(F.slice(F.array_sort(scored), 1, fallback))
    return profiles.select(*keys, F.posexplode(pick).alias("i", "t")).select(*keys, (C("i") + 1).cast("long").alias("rank"), "t.keyword", (-C("t.neg")).cast("long").alias("score"))


def label_progress(labelled: DataFrame, minimum: int = 20, target: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    counts = labelled.select(*keys, F.explode("labels").alias("label")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "label", "n", (C("n") < minimum).alias("below_minimum"), (C("n") >= target).alias("done"))


def triplet_accuracy(triplets: DataFrame, vectors: DataFrame, weights: list[list[float]] | None = None) -> DataFrame:
    """Share of triplets with a·p > a·n after projection. The vectors are projected once, then joined three times."""
    v = vectors.select("object_id", "vec")
    v = vec.project_rows(v, weights, unit=False) if weights else v
    rows = triplets
    for side in ("anchor", "positive", "negative"):
        rows = rows.join(v.select(C("object_id").alias(side), C("vec").alias(f"__{side}")), side)
    ok = vec.dot(C("__anchor"), C("__positive")) > vec.dot(C("__anchor"), C("__negative"))
    return rows.agg(F.avg(ok.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def leak_rate(results: DataFrame, briefs: DataFrame, top: int = 6, keys: Sequence[str] = ("query_id", "category")) -> DataFrame:
    """Titles among the first six that contain an anti-leak word of the brief."""
    rows = results.where(C("rank") <= top).join(briefs.select("query_id", "anti_leak"), "query_id")
    leak = F.exists("anti_leak", lambda w: F.lower(C("title")).contains(F.lower(w)))
    return rows.groupBy(*keys).agg(F.count_if(leak).alias("leaks"), F.count(F.lit(1)).alias("shown"))
