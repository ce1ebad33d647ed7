"""Keyword search, query classification and the two retrieval pipelines (hybrid and two-stage)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import steer
from modiste.operators import ranking, sets, topk
from modiste.operators.filters import allowed_bands, holds_avoided
from modiste.operators.joins import hydrate_inner, token_theta
from modiste.session import cut
from modiste.scale import broadcast_measured, first_k, numbered, with_group_stats

C = F.col
ATTRIBUTES = ["title", "brand", "description", "color", "material", "aesthetic_tags", "retailer", "category"]
SPLIT = r"[^\p{L}\p{N}]+"


def classify_queries(queries: DataFrame, brands: DataFrame) -> DataFrame:
    """Add has_brand / has_garment / has_color and the class to each query."""
    b = brands.select(F.trim(F.lower("brand")).alias("__brand")).where("__brand <> ''").distinct()
    branded = token_theta(queries.select("query_id", "text"), b, "text", "__brand").select("query_id").distinct().withColumn("__has", F.lit(True))
    flagged = queries.join(branded, "query_id", "left")
    c = steer.query_classify(C("text"), F.coalesce("__has", F.lit(False)))
    return flagged.withColumn("__c", c).select(*queries.columns, "__c.has_brand", "__c.has_garment", "__c.has_color", "__c.type")


def product_terms(products: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> Column:
    """array<struct<t, a>>: the words of a product with the number of the attribute they stand in."""
    parts = []
    for i, a in enumerate(x for x in attributes if x in products.columns):
        raw = F.array_join(a, " ") if products.schema[a].dataType.typeName() == "array" else C(a)
        words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(raw, F.lit(""))), SPLIT), lambda w: w != ""))
        parts.append(_marked(words, i))
    return F.flatten(F.array(*parts))


def _marked(words: Column, number: int) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("t"), F.lit(number).alias("a")))


def query_words(text: Column) -> tuple[Column, Column]:
    """(wanted words, negated words) of a query text."""
    raw = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")

    def words(c):
        return F.array_distinct(F.filter(F.flatten(F.transform(c, lambda w: F.split(w, SPLIT))), lambda w: w != ""))

    return words(F.filter(raw, lambda w: ~w.startswith("-"))), words(F.filter(raw, lambda w: w.startswith("-")))


def keyword_search(queries: DataFrame, products: DataFrame, k: int | None, keys: Sequence[str] = ("query_id",), optional: bool = False,
                   attributes: Sequence[str] = ATTRIBUTES, order_group: Sequence[str] = (), unless: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Products matching the words of each query, best first.

    A log repeats its texts: queries that ask for the same are searched once, and the ranked result goes to each of them. `unless` names a column of
    the queries with terms and the product fields that mustn't hold one of these; such rows are left out before they are ranked.

    Every word is required unless `optional`; `-word` excludes. Queries may carry `price_range`, `category` and `boosts`
    (tags that lift a product). Order: words matched, best attribute, boosts, price, id.

    A required query is looked up by its rarest word only and the rest is verified on the joined row. An optional query is
    looked up by every word, and the row survives only at its first matching word, so no re-grouping is needed.
    """
    want, avoid = query_words(C("text"))
    q = queries.withColumn("__want", want).withColumn("__avoid", avoid).where(F.size("__want") > 0)
    q = q.withColumn("__boosts", C("boosts") if "boosts" in queries.columns else F.array().cast("array<string>"))
    carried = [c for c in ("price_range", "category") if c in queries.columns]
    q = q.select(*keys, "__want", "__avoid", "__boosts", *[C(c).alias(f"__q_{c}") for c in carried], *([C(unless[0]).alias("__terms_out")] if unless else []))
    asked = [c for c in q.columns if c not in keys]
    q = cut(q.withColumn("__search", F.md5(F.to_json(F.struct(*asked)))))
    askers, keys, q = q.select(*keys, "__search"), ["__search"], q.select("__search", *asked).dropDuplicates(["__search"])
    tags = C("aesthetic_tags") if "aesthetic_tags" in products.columns else F.array().cast("array<string>")
    held = [C(f).alias(f"__f_{f}") for f in unless[1] if f in products.columns] if unless else []
    p = products.select("object_id", "price", "price_range", C("category").alias("__category"), *order_group, tags.alias("__tags"), product_terms(products, attributes).alias("__terms"), *held)
    p = p.withColumn("__have", F.array_distinct(F.transform("__terms", lambda e: e["t"])))
    if optional:
        q = q.withColumn("__word", F.explode("__want"))
    else:
        used = q.select(F.explode("__want").alias("__word")).distinct()
        freq = p.select(F.explode("__have").alias("__word")).join(used, "__word", "left_semi").groupBy("__word").agg(F.count(F.lit(1)).alias("__df"))
        rare = (q.select(*keys, F.explode("__want").alias("__word")).join(freq, "__word", "left")
                .groupBy(*keys).agg(F.min_by("__word", F.struct(F.coalesce("__df", F.lit(0)), C("__word"))).alias("__word")))
        q = q.join(rare, list(keys))
    # the query side has a row per search (per word when optional); while it is small the exploded catalogue is never shuffled
    hits = p.withColumn("__word", F.explode("__have")).join(broadcast_measured(q), "__word")

    def has(w):
        return F.array_contains("__have", w)

    # plain look-ups in a short word list: cheaper per candidate than building sets
    keep = ~F.exists("__avoid", has)
    keep = keep & (F.get(F.filter("__want", has), F.lit(0)) == C("__word") if optional else F.forall("__want", has))
    n_matched = F.size(F.filter("__want", has)) if optional else F.size("__want")
    if "price_range" in carried:
        keep = keep & (C("__q_price_range").isNull() | F.array_contains(allowed_bands(C("__q_price_range")), C("price_range")))
    if "category" in carried:
        keep = keep & (C("__q_category").isNull() | (C("__q_category") == C("__category")))
    if unless:
        keep = keep & ~holds_avoided(C("__terms_out"), [f"__f_{f}" for f in unless[1] if f in products.columns], split=False)
    best = F.array_min(F.transform(F.filter("__terms", lambda e: F.array_contains("__want", e["t"])), lambda e: e["a"]))
    found = hits.where(keep).select(*keys, *order_group, "object_id", n_matched.cast("long").alias("matched"), best.cast("long").alias("best_attribute"),
                                    F.size(F.array_intersect("__boosts", "__tags")).cast("long").alias("boosted"), "price")
    order = [C("matched").desc(), C("best_attribute").asc(), C("boosted").desc(), C("price").desc_nulls_last(), C("object_id").asc()]
    groups = [*keys, *order_group]
    ranked = numbered(found, groups, order, "rank") if k is None else first_k(found, groups, order, k, "rank")
    return askers.join(ranked, "__search").drop("__search")


def multi_query(subqueries: DataFrame, products: DataFrame, per_category: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Several texts per (query, category): each asks for max(3, ⌈2m/q⌉) items; the lists are merged in text order."""
    group = [*keys, "category"]
    sized = with_group_stats(subqueries, group, __q=F.count(F.lit(1)))
    limit = F.greatest(F.lit(3), F.ceil(F.lit(2.0 * per_category) / C("__q")))
    sized = sized.select(*subqueries.columns, limit.alias("__limit"))
    hits = keyword_search(sized, products, max(3, 2 * per_category), [*group, "sub_id"])
    hits = hits.join(sized.select(*group, "sub_id", "__limit"), [*group, "sub_id"]).where(C("rank") <= C("__limit"))
    return sets.union_distinct_ordered(hits, group, ("sub_id", "rank"))


#: fixed values: the word that leans a search towards a category
HINTS = {"dress": "", "top": "top", "bottom": "skirt", "jacket": "jacket", "shoes": "shoes", "bag": "bag"}


def category_search(queries: DataFrame, products: DataFrame, per_category: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(keys, bucket, tier, pos, object_id): one text per (query, bucket), a bucket being a category. Searched within the category first; while that
    gives fewer than half of `per_category`, without it but with the category's hint word; while the two give fewer than two, by
    the last two words of the text. The first two ask for twice `per_category`, the last for `per_category`."""
    group, wide = [*keys, "bucket"], max(3, 2 * per_category)
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), C("bucket"))
    hinted = F.when((hint != "") & ~F.contains(F.lower("text"), hint), F.concat_ws(" ", "text", hint)).otherwise(C("text"))
    last_two = F.array_join(F.slice(F.split(F.trim("text"), " "), F.greatest(F.lit(1), F.size(F.split(F.trim("text"), " ")) - 1), F.lit(2)), " ")
    tiers = [lambda q: keyword_search(q.withColumn("category", C("bucket")), products, wide, group),
             lambda q: keyword_search(q.withColumn("text", hinted), products, wide, group),
             lambda q: keyword_search(q.withColumn("text", last_two), products, per_category, group)]
    return sets.fallback_widen(queries, tiers, group, [max(2, per_category // 2), 2])


def with_categories(vectors: DataFrame, products: DataFrame) -> DataFrame:
    return vectors.join(products.select("object_id", "category"), "object_id").select("object_id", "category", "vec")


def hybrid(queries: DataFrame, products: DataFrame, visual: DataFrame, vibe: DataFrame, top: int = 50, floor: float | None = None, weights: dict[str, float] | None = None,
           taste: DataFrame | None = None, neighbours: int | None = None) -> DataFrame:
    """Visual, vibe, taste (where given) and keyword lists per category fused by reciprocal ranks, then hydrated: (query, category, rank, product).

    Neighbours are taken once per query and list, `neighbours` of them (at least 200, ten for each place), and grouped by category after that, twice
    `top` per list. Items keep the order in which the lists, in the order above, first bring them."""
    weights = {"visual": 3.0, "vibe": 1.0, "taste": 1.0, "keyword": 0.5} | (weights or {})
    k, sources = neighbours or max(200, 10 * top), [("visual", visual), ("vibe", vibe)] + ([("taste", taste)] if taste is not None else [])
    found = None
    for number, (_, vectors) in enumerate(sources):
        near = topk.nearest(queries, vectors, k, floor).select("query_id", "object_id", F.lit(number).alias("number"), "rank")
        found = near if found is None else found.unionByName(near)
    firsts = found.groupBy("query_id", "object_id").agg(F.min(F.struct("number", "rank")).alias("first"), F.collect_set("number").alias("numbers"))
    firsts = firsts.join(products.select("object_id", "category"), "object_id").select("query_id", "category", "object_id", "first", F.explode("numbers").alias("number"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in sources]), C("number") + 1)
    near = first_k(firsts, ["query_id", "category", "number"], ["first", "object_id"], 2 * top, "rank").select("query_id", "category", name.alias("list"), "rank", "object_id")
    text = keyword_search(queries.select("query_id", "text"), products, 2 * top, order_group=["category"])
    ranked = near.unionByName(text.select("query_id", "category", F.lit("keyword").alias("list"), "rank", "object_id"))
    fused = ranking.rrf(ranked, ["query_id", "category"], weights, top)
    return hydrate_inner(fused, products, ["title", "brand", "price"])


def two_stage(queries: DataFrame, phrases: DataFrame, products: DataFrame, visual: DataFrame, vibe: DataFrame, centroids: DataFrame | None, features: DataFrame | None,
              per_category: int = 50, gate_floor: float = 0.18, rerank_floor: float = 0.30, phrase_threshold: float = 0.28, align: tuple[float, float] = (0.15, 0.30),
              min_pool: int = 30, taste: DataFrame | None = None) -> DataFrame:
    """Gate (keyword ∪ phrase neighbours) → floor and rerank → diversity; small pools fall back to `hybrid`, with the taste list where it is given.

    One DAG for all queries. Literal queries skip the semantic gate before any vector is touched.
    """
    kinds = classify_queries(queries, products.select("brand"))
    lam = F.when(C("type") == "literal", 0.10).when(C("type") == "mixed", 0.30).otherwise(0.40)
    kinds = kinds.select("query_id", "user_token", "text", "vec", "type", lam.alias("lam"))
    keyword = keyword_search(queries.select("query_id", "text", "price_range"), products, per_category * 4, order_group=["category"])
    semantic_for = phrases.join(kinds.where("type <> 'literal'").select("query_id"), "query_id", "left_semi")
    semantic = topk.per_phrase_union(semantic_for, with_categories(visual, products), floor=gate_floor)
    keyword = cut(keyword)
    pool = cut(sets.pool_merge(keyword, semantic, ["query_id", "category"]))  # narrow id rows, used several times below
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("__pool"))
    big = sizes.where(C("__pool") >= min_pool)
    fractions = ranking_fraction(keyword)
    pool = pool.join(big.select("query_id"), "query_id", "left_semi").join(fractions, ["query_id", "category", "object_id"], "left")
    scored = ranking.rerank(pool, kinds, products, visual, vibe, centroids, features, phrases, rerank_floor, phrase_threshold, align)
    strict = ranking.mmr(scored, per_category)
    strict = strict.select("query_id", "category", C("mmr_pos").alias("rank"), "object_id", F.lit("two_stage").alias("stage"))
    rest = cut(queries.join(big.select("query_id"), "query_id", "left_anti"))
    if rest.isEmpty():
        return strict
    loose = hybrid(rest, products, visual, vibe, per_category, gate_floor, {"visual": 1.0, "vibe": 1.0, "taste": 1.0, "keyword": 0.25}, taste)
    return strict.unionByName(loose.select("query_id", "category", "rank", "object_id", F.lit("hybrid").alias("stage")))


def ranking_fraction(keyword: DataFrame) -> DataFrame:
    """Keyword rank of the gate list as 1 … 0 per (query, category)."""
    keys = ["query_id", "category"]
    n = with_group_stats(keyword.select(*keys, "object_id", "rank"), keys, __n=F.count(F.lit(1)))
    value = F.when(C("__n") == 1, F.lit(1.0)).otherwise(1 - (C("rank") - 1) / (C("__n") - 1))
    return n.select(*keys, "object_id", value.alias("kw_fraction"))


def optional_search(queries: DataFrame, products: DataFrame, k: int, fields: Sequence[str] = ("title", "category", "color")) -> DataFrame:
    """Any word matches, more matches rank higher; rows that hold one of the query's avoid terms are left out before they are ranked."""
    return keyword_search(queries.select("query_id", "text", "avoids"), products, k, optional=True, unless=("avoids", fields))
