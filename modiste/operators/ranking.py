"""Fusion, reranking, diversity and feed composition.

Sequential algorithms (MMR, brand spread, wildcards, diverse picks) run per bounded page or pool with numpy in
`applyInPandas`; the bound is the feature's own pool size, never a sample.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import scores, vec
from modiste.functions.text import clean
from modiste.functions.vec import half_up
from modiste.operators import topk
from modiste.operators.windows import adaptive_norm_column, brand_key
from modiste.scale import broadcast_measured, first_k, numbered, with_group_stats
from modiste.session import cut

C = F.col
RRF_K = 60


# ── fusion ────────────────────────────────────────────────────────────────────
def rrf(lists: DataFrame, keys: Sequence[str], weights: dict[str, float] | None = None, top: int = 50, k: int = RRF_K) -> DataFrame:
    """Σ weight/(rank0 + k) over ranked lists (keys, list, 1-based rank, object_id); best `top` per key."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])[C("list")], F.lit(0.0))
    parts = lists.withColumn("__w", w).where("__w <> 0")
    fused = parts.groupBy(*keys, "object_id").agg(F.round(F.sum(C("__w") / (C("rank") - 1 + k)), 9).alias("score"))
    return first_k(fused, keys, [C("score").desc(), "object_id"], top, "rank").select(*keys, "rank", "object_id", "score")


def reciprocal_merge(lists: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """Σ 1/(i+1) over the lists."""
    return rrf(lists, keys, None, top, k=1)


# ── rerank features ───────────────────────────────────────────────────────────
AFFINITY_WEIGHTS = {"brand": 0.5, "color": 0.3, "retailer": 0.2}


def click_affinity(candidates: DataFrame, features: DataFrame, user: str = "user_token", out: str = "click_affinity") -> DataFrame:
    """Weighted share of each attribute's click weight relative to the user's strongest value of it; at most 1."""
    share = with_group_stats(features, [user, "feature"], __max=F.max("weight")).where("__max > 0").select(user, "feature", "value", (C("weight") / C("__max")).alias("__s"))
    total = F.lit(0.0)
    df = candidates
    for name, weight in AFFINITY_WEIGHTS.items():
        part = share.where(C("feature") == name).select(C(user).alias("__u"), C("value").alias("__v"), C("__s").alias(f"__{name}"))
        df = df.join(part, (C(user) == C("__u")) & (clean(C(name)) == C("__v")), "left").drop("__u", "__v")
        total = total + weight * F.coalesce(C(f"__{name}"), F.lit(0.0))
    return df.withColumn(out, F.least(F.lit(1.0), total)).drop(*[f"__{n}" for n in AFFINITY_WEIGHTS])


def phrase_vectors(phrases: DataFrame) -> DataFrame:
    """(query_id, __phrases): the vectors of a query's phrases, those without one left out. A query has a handful of phrases."""
    return phrases.where(C("vec").isNotNull()).groupBy("query_id").agg(F.collect_list("vec").alias("__phrases"))


def phrase_share(item: Column, phrases: Column, threshold: float, full: float) -> Column:
    """`full` × share of the phrase vectors that the item vector is close to; 0 without either."""
    near = F.filter(phrases, lambda p: F.round(vec.cosine(item, p), 6) >= threshold)
    return F.coalesce(F.when(item.isNotNull(), full * F.size(near) / F.size(phrases)), F.lit(0.0))


def phrase_bonus(candidates: DataFrame, phrases: DataFrame, visual: DataFrame, threshold: float = 0.28, full: float = 0.18, out: str = "phrase_bonus") -> DataFrame:
    """`full` × share of the query's phrases the item is close to, for the candidates only."""
    joined = candidates.join(visual.select("object_id", C("vec").alias("__v")), "object_id", "left").join(phrase_vectors(phrases), "query_id", "left")
    return joined.withColumn(out, phrase_share(C("__v"), C("__phrases"), threshold, full)).drop("__v", "__phrases")


SIMILAR = "vis double, cent double, vib double, near int"


def similarities(threshold: float):
    """The cosines of an item's vector with the query's and the centre's, that of its vibe with the query's, and how many phrases it is close to, as one Arrow
    function of (query, item, centre, vibe, phrases), all packed. Arrays are multiplied many rows at a time."""

    def filled(values: np.ndarray, known: np.ndarray) -> pa.Array:
        return pa.array(values, mask=~known)

    def similar(query: pa.Array, item: pa.Array, centre: pa.Array, vibe: pa.Array, phrases: pa.Array) -> pa.Array:
        of, each = pc.list_parent_indices(phrases), pc.list_flatten(phrases)
        values, known = vec.cosine_rows(item.take(of), each)
        rounded = half_up(values, 6)
        close = known & (np.isnan(rounded) | (rounded >= threshold))
        near = np.bincount(of.to_numpy(zero_copy_only=False)[close], minlength=len(query)).astype(np.int32)
        found = [filled(*vec.cosine_rows(x, y)) for x, y in ((query, item), (centre, item), (query, vibe))]
        return pa.StructArray.from_arrays([*found, pa.array(near)], ["vis", "cent", "vib", "near"])

    # not deterministic, so that a filter on a result isn't moved below and the function called twice
    return F.arrow_udf(similar, SIMILAR).asNondeterministic()


def weight_policy(alignment: Column, vibe_share: Column, align: tuple[float, float] = (0.15, 0.30), dropout: float = 0.5) -> tuple[Column, Column, Column]:
    """(visual, vibe, centroid) weights: the centroid counts by its alignment with the query, vibe only when half the pool has it."""
    w_cent = F.when(alignment.isNull(), 0.0).when(alignment < align[0], 0.05).when(alignment < align[1], 0.15).otherwise(0.25)
    rest, base = 1 - w_cent, 0.6 + 0.15
    use = vibe_share >= dropout
    return F.when(use, rest * (0.6 / base)).otherwise(rest), F.when(use, rest * (0.15 / base)).otherwise(0.0), w_cent


def rerank(pool: DataFrame, queries: DataFrame, products: DataFrame, visual: DataFrame, vibe: DataFrame, centroids: DataFrame | None, features: DataFrame | None,
           phrases: DataFrame | None, floor: float = 0.30, phrase_threshold: float = 0.28, align: tuple[float, float] = (0.15, 0.30), with_vectors: bool = True) -> DataFrame:
    """Score a gated pool (query_id, category, object_id, kw_fraction). Vectors meet a candidate once; all similarities and the phrase bonus are taken there,
    so windows and affinities move narrow rows. `with_vectors` adds the item's own vector, packed, as `vec` to what has been scored."""
    keys = ["query_id", "category"]
    q = queries.select("query_id", "user_token", C("vec").alias("__q"), *(["lam"] if "lam" in queries.columns else []))
    if centroids is not None:
        q = q.join(centroids.select("user_token", C("vec").alias("__c")), "user_token", "left")
    else:
        q = q.withColumn("__c", F.lit(None).cast("array<double>"))
    q = q.withColumn("__align", vec.cosine(C("__c"), C("__q"))).withColumns({c: vec.packed(c) for c in ("__q", "__c")})
    if phrases is not None:
        # a phrase whose vector holds null packs to nothing and stays in the list
        own = phrases.where(C("vec").isNotNull()).withColumn("__p", vec.packed("vec")).groupBy("query_id").agg(F.collect_list(F.struct("__p")).alias("__phrases"))
        q = q.join(own.withColumn("__phrases", C("__phrases.__p")), "query_id", "left")
    else:
        q = q.withColumn("__phrases", F.lit(None).cast("array<binary>"))
    attrs = products.select("object_id", "brand", "color", "retailer")
    # what belongs to an item is joined by its id, which moves ids only; candidates move with vectors once, to their query. The number of a vector's row
    # brings it back at the end, also where an id repeats
    visual = cut(visual.select("object_id", vec.packed("vec").alias("__v")).withColumn("__row", F.monotonically_increasing_id()))
    vibe = vibe.select("object_id", vec.packed("vec").alias("__b"))
    df = pool.join(visual, "object_id", "left").join(vibe, "object_id", "left").join(attrs, "object_id").join(broadcast_measured(q), "query_id")
    df = df.withColumn("__s", similarities(phrase_threshold)("__q", "__v", "__c", "__b", "__phrases")).withColumns({c: C(f"__s.{c}") for c in ("vis", "cent", "vib")})
    bonus = F.coalesce(F.when(C("__v").isNotNull(), F.lit(0.18) * C("__s.near") / F.size("__phrases")), F.lit(0.0))
    df = df.withColumn("phrase_bonus", bonus).drop("__c", "__phrases", "__q", "__v", "__b", "__s").where(C("vis").isNull() | (C("vis") >= floor))
    # ranking ties are decided on rounded scores so that every engine orders them alike
    # a pool is what the gate lets through (≤ 700 rows), so plain windows are safe and all of them share one shuffle
    names = ("vis", "vib", "cent")
    df = df.withColumns({c: F.round(c, 9) for c in names})
    df = df.withColumns({**{f"n_{c}": adaptive_norm_column(C(c), keys, ["object_id"]) for c in names},
                         "__share": F.avg(C("vib").isNotNull().cast("double")).over(Window.partitionBy(*keys))})
    w_vis, w_vib, w_cent = weight_policy(C("__align"), C("__share"), align)
    df = click_affinity(df, features) if features is not None else df.withColumn("click_affinity", F.lit(0.0))
    score = (w_vis * C("n_vis") + w_vib * C("n_vib") + w_cent * C("n_cent") + 0.10 * C("click_affinity")
             + 0.05 * F.coalesce("kw_fraction", F.lit(0.0)) + C("phrase_bonus"))
    df = df.withColumn("score", F.round(score, 9)).drop("__align", "__share")
    return (df.join(visual.select("__row", C("__v").alias("vec")), "__row", "left") if with_vectors else df).drop("__row")


def mmr(scored: DataFrame, per_group: int, keys: Sequence[str] = ("query_id", "category"), brand_penalty: float = 0.15, default_lambda: float = 0.3) -> DataFrame:
    """Greedy maximal marginal relevance per (query, category): score − λ·max similarity − 0.15 for a repeated brand.

    The pool is what the gate lets through (at most 700 rows per group), so a group always fits its task."""
    keys = list(keys)
    lam = C("lam") if "lam" in scored.columns else F.lit(default_lambda)
    held = C("vec") if scored.schema["vec"].dataType.typeName() == "binary" else vec.packed("vec").alias("vec")  # moved as bytes
    narrow = scored.select(*keys, "object_id", "score", clean(C("brand")).alias("brand"), held, lam.cast("double").alias("lam"))
    schema = narrow.select(*keys, "object_id", "score").withColumn("mmr_pos", F.lit(1).cast("long")).schema

    def picked(score: np.ndarray, brands: np.ndarray, m: np.ndarray, lam_v: float) -> list[int]:
        n = len(score)
        if not (lam_v > 0 and n > 1):
            return list(range(min(n, per_group)))
        closest, penalty, left, chosen = np.zeros(n), np.zeros(n), np.ones(n, bool), []
        for _ in range(min(n, per_group)):
            i = int(np.argmax(np.where(left, np.round(score - lam_v * closest - penalty, 9), -np.inf)))
            chosen.append(i)
            left[i] = False
            closest = np.maximum(closest, m @ m[i])
            if brands[i]:
                penalty[brands == brands[i]] = brand_penalty
        return chosen

    def pick(batches):
        for rows in groups_of(batches, len(keys)):
            column = {c: rows.column(c) for c in ("score", "brand", "lam")}
            score = column["score"].to_numpy(zero_copy_only=False).astype(np.float64)
            brands = pc.fill_null(column["brand"].dictionary_encode().indices, 0).to_numpy(zero_copy_only=False) + 1
            brands[pc.equal(pc.fill_null(column["brand"], ""), "").to_numpy(zero_copy_only=False)] = 0
            lam_v = column["lam"][0].as_py()
            chosen = picked(score, brands, unit_rows(rows.column("vec")), np.nan if lam_v is None else lam_v)
            out = rows.select([*keys, "object_id", "score"]).take(pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.arange(1, len(chosen) + 1))], names=schema.names)

    def together(batches):
        """Groups are small: many leave at once."""
        held = []
        for b in pick(batches):
            held.append(b)
            if len(held) == 200:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    last = F.isnan("score") | C("score").isNull()
    lying = narrow.repartition(*keys).sortWithinPartitions(*keys, last, C("score").desc(), C("object_id").asc_nulls_last())
    return lying.mapInArrow(together, schema)


def unit_rows(vectors: pa.BinaryArray) -> np.ndarray:
    """A matrix of packed vectors, of unit length; missing ones are zero."""
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    some = np.flatnonzero(known)
    if not len(some):
        return np.zeros((len(vectors), 1))
    data, ends = np.frombuffer(vectors.buffers()[2], np.uint8), np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    kinds = data[ends[some]]
    m = np.zeros((len(vectors), int((ends[some[0] + 1] - ends[some[0]] - 1) // kinds[0])))
    for kind, item in ((4, np.float32), (8, np.float64)):
        own = some[kinds == kind]
        if len(own):
            m[own] = data[ends[own][:, None] + 1 + np.arange(m.shape[1] * kind)].view(item)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def groups_of(batches, n_keys: int):
    """Record batches of one group each, rows lying together by their first `n_keys` columns; a group is held whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*held, batch]) if held else batch
        codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in rows.columns[:n_keys]]
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for c in codes:
            new |= np.diff(c) != 0
        ends = (np.flatnonzero(new) + 1).tolist()
        for at, end in zip([0, *ends], ends):
            yield rows.slice(at, end - at)
        start = ends[-1] if ends else 0
        held = [rows.slice(start)] if rows.num_rows > start else []
    yield from held


def quality_gate(ranked: DataFrame, queries: DataFrame, visual: DataFrame, threshold: float = 0.22, keys: Sequence[str] = ("query_id", "category")) -> DataFrame:
    """Drop a category whose first item is too far from the query centroid; a missing vector passes."""
    top = ranked.where(C("rank") == 1).join(queries.select("query_id", C("vec").alias("__q")), "query_id").join(visual.select("object_id", "vec"), "object_id")
    bad = top.where(vec.cosine(C("__q"), C("vec")) < threshold).select(*keys)
    return ranked.join(bad, list(keys), "left_anti")


# ── axes and session ──────────────────────────────────────────────────────────
def axis_match(profile: dict[str, Column], item: dict[str, Column]) -> Column:
    """mean(1-|Δ|) over axes both sides know, else 0.5."""
    known = [profile[a].isNotNull() & item[a].isNotNull() for a in profile]
    total = sum((F.when(k, 1 - F.abs(profile[a] - item[a])).otherwise(0.0) for k, a in zip(known, profile)), F.lit(0.0))
    n = sum((k.cast("int") for k in known), F.lit(0))
    return F.when(n > 0, total / n).otherwise(0.5)


def axis_filter_band(mean: Column, radius: float = 0.25) -> tuple[Column, Column]:
    """The preferred band around a mean; null bounds when it would cover everything."""
    lo, hi = F.greatest(F.lit(0.0), mean - radius), F.least(F.lit(1.0), mean + radius)
    useful = ~((lo <= 0.001) & (hi >= 0.999))
    return F.when(useful, lo), F.when(useful, hi)


def apply_axis_delta(mean: Column, delta: Column) -> Column:
    return F.when(delta.isNull(), mean).otherwise(scores.clamp(F.coalesce(mean, F.lit(0.5)) + delta, 0, 1))


# ── cards ─────────────────────────────────────────────────────────────────────
def card_score(cards: DataFrame, hits: DataFrame, dislikes: DataFrame, history: DataFrame, multipliers: DataFrame, liked: DataFrame, recent_categories: DataFrame,
               user: str = "user_token") -> DataFrame:
    """Card scores from per-item affinities.

    cards: (user, card_id, object_id, brand, category, color, price_range, aesthetic_price, fresh); hits and dislikes:
    (user, feature, value, hits); history: (user, n_clicks); multipliers: (user, multiplier); liked: (user, object_id);
    recent_categories: (user, category) of the ten newest clicks.
    """
    df = cards
    for name, exact in (("category", True), ("brand", False), ("color", False)):
        value = C(name) if exact else F.lower(C(name))
        for tag, source in (("h", hits), ("d", dislikes)):
            part = source.where(C("feature") == name).select(C(user).alias("__u"), C("value").alias("__v"), C("hits").alias(f"{tag}_{name}"))
            df = df.join(part, (C(user) == C("__u")) & (value == C("__v")), "left").drop("__u", "__v")
    df = df.join(history, user, "left").join(multipliers, user, "left")
    df = df.join(liked.select(user, "object_id").distinct().withColumn("__liked", F.lit(True)), [user, "object_id"], "left")
    df = df.join(recent_categories.select(user, "category").distinct().withColumn("__known", F.lit(True)), [user, "category"], "left")

    def h(name):
        return F.coalesce(C(name), F.lit(0))

    def with_history(attr, none, value):
        return F.when((F.coalesce(C(attr), F.lit("")) == "") | (h("n_clicks") == 0), F.lit(none)).otherwise(value)

    cat = with_history("category", 0.5, F.least(F.lit(0.98), 0.20 + h("h_category") * 0.38))
    brand = with_history("brand", 0.30, F.when(h("h_brand") == 0, 0.40).otherwise(F.least(F.lit(0.98), 0.75 + (h("h_brand") - 1) * 0.12)))
    color = with_history("color", 0.50, F.least(F.lit(0.95), 0.30 + h("h_color") * 0.32))
    pen_cat = F.least(F.lit(0.45), h("d_category") * 0.16)
    pen_brand = F.when(h("d_brand") == 0, 0.0).otherwise(F.least(F.lit(0.55), 0.30 + (h("d_brand") - 1) * 0.15))
    pen_color = F.least(F.lit(0.40), h("d_color") * 0.14)
    blank = F.coalesce(C("price_range"), F.lit("")) == ""
    price = F.when(blank, 0.60).when(C("price_range") == C("aesthetic_price"), 1.0).when(C("price_range") == "mid", 0.70).otherwise(0.40)
    novel = ((F.coalesce(C("category"), F.lit("")) != "") & C("__known").isNull()).cast("double")
    per = df.groupBy(user, "card_id").agg(
        F.avg(cat).alias("cat"), F.avg(brand).alias("brand"), F.avg(color).alias("color"), F.avg(price).alias("price"), F.max(pen_cat).alias("pc"), F.max(pen_brand).alias("pb"),
        F.max(pen_color).alias("pk"), F.avg(novel).alias("novelty"), F.max(F.coalesce("__liked", F.lit(False))).alias("liked"), F.max("fresh").alias("fresh"),
        F.first(F.coalesce("multiplier", F.lit(1.0))).alias("mult"))
    like = scores.clamp((C("cat") * 0.38 + C("brand") * 0.22 + C("color") * 0.20 + C("price") * 0.15 + 0.05) * C("mult") + C("liked").cast("double") * 0.10
                        - C("pc") * 0.50 - C("pk") * 0.30, 0.02, 0.97)
    n = C("novelty")
    comment = scores.clamp(F.when(n < 0.25, 0.15 + n * 1.20).when(n < 0.65, 0.50 + (n - 0.25) * 0.60).otherwise(0.50 - (n - 0.65) * 0.80), 0.05, 0.90)
    click = scores.clamp(C("cat") * 0.35 + C("brand") * 0.35 + C("price") * 0.20 + 0.10 - C("pb") * 0.55 - C("pc") * 0.35, 0.02, 0.95)
    out = per.select(user, "card_id", like.alias("p_like"), comment.alias("p_comment"), click.alias("p_click"), C("fresh").alias("fresh"))
    total = C("p_like") * 0.55 + C("p_comment") * 0.15 + C("p_click") * 0.30 + C("fresh").cast("double") * 0.06
    return out.select(user, "card_id", F.round(total, 9).alias("score"), "p_like", "p_comment", "p_click")


def promoted(novelty: np.ndarray, stride: int) -> list[int]:
    """The order of a queue in which every `stride`-th slot goes to the most novel card behind the one whose turn it is; what is promoted moves ahead, the
    rest keeps its order. A heap holds the cards by novelty, and those that have left the queue are dropped when they come up: n log n steps."""
    n = len(novelty)
    heap = [(not np.isnan(x), -x, i) for i, x in enumerate(novelty.tolist())]
    heapq.heapify(heap)
    gone, out, turn = np.zeros(n + 2, bool), [], 0

    def after(i: int) -> int:
        while i < n and gone[i]:
            i += 1
        return i

    while len(out) < n:
        turn = after(turn)
        if (len(out) + 1) % stride == 0:
            # the card at turn is out before the next such slot, so it needn't come up again
            while heap and (gone[heap[0][2]] or heap[0][2] <= turn):
                heapq.heappop(heap)
            if heap and heap[0][2] != after(turn + 1):
                best = heapq.heappop(heap)[2]
                gone[best] = True
                out.append(best)
                continue
        gone[turn] = True
        out.append(turn)
    return out


def wildcards(cards: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Promote the most novel remaining card every `stride` slots (stride 9 − 6·explore). Sequential over the whole queue of a session, which is
    the input of one call: the cards of one feed request."""
    keys = list(keys)
    queues = cards.select(*keys, "card_id", C(pos).alias("pos"), "p_comment", "explore")
    schema = queues.select(*keys, "card_id").withColumn("new_pos", F.lit(1).cast("long")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        start = int(pdf["pos"].min())
        stride = int(min(9, max(3, np.floor(9 - pdf["explore"].iloc[0] * 6 + 0.5))))
        out = pdf.loc[promoted(pdf["p_comment"].to_numpy(np.float64), stride), [*keys, "card_id"]].copy()
        out["new_pos"] = np.arange(start, start + len(out))
        return out

    return queues.groupBy(*keys).applyInPandas(run, schema)


def upcoming_only(df: DataFrame, keys: Sequence[str], current: Column, pos: str = "pos", score: str = "score", out: str = "new_pos") -> DataFrame:
    """Rows up to the current index keep their place; the rest is ordered by score."""
    frozen = C(pos) <= current
    return numbered(df.withColumn("__f", (~frozen).cast("int")).withColumn("__s", F.when(frozen, F.lit(0.0)).otherwise(-C(score))), keys,
                    ["__f", "__s", pos, "object_id"], out).drop("__f", "__s")


def spread(brands: Sequence[int], cooldown: int) -> list[int]:
    """The order of items in which each slot goes to the brand with most items left that isn't among the last `cooldown` brands, ties to the brand that
    comes first; where all brands left are among these, to the one not seen for longest. `brands` numbers the brands in the order of first items.

    Brands with items that are free to go wait in a heap by items left; those cooling down are a ring of at most `cooldown`."""
    queues: list[deque] = [deque() for _ in range(max(brands, default=-1) + 1)]
    for i, b in enumerate(brands):
        queues[b].append(i)
    free = [(-len(q), b) for b, q in enumerate(queues)]
    heapq.heapify(free)
    ring: list[int] = []
    out: list[int] = []
    while len(out) < len(brands):
        if free:
            b = heapq.heappop(free)[1]
        else:
            b = next(x for x in ring if queues[x])
            ring.remove(b)
        out.append(queues[b].popleft())
        ring.append(b)
        if len(ring) > cooldown:
            back = ring.pop(0)
            if queues[back]:
                heapq.heappush(free, (-len(queues[back]), back))
    return out


def spread_brand(df: DataFrame, keys: Sequence[str], page: str, cooldown: int = 4, pos: str = "pos") -> DataFrame:
    """Most-remaining brand not among the last `cooldown` brands, within each page of a paged lane; `page` names the column with its number."""
    keys = list(keys)
    paged = (df.withColumn("page", C(page))
             .select(*keys, "page", "object_id", C(pos).alias("pos"), brand_key(C("brand"), C("retailer")).alias("bk")))
    schema = paged.select(*keys, "page", "object_id", "bk").withColumn("new_pos", F.lit(1).cast("long")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        start = int(pdf["pos"].min())
        res = pdf.loc[spread(pd.factorize(pdf["bk"])[0].tolist(), cooldown), [*keys, "page", "object_id", "bk"]].copy()
        res["new_pos"] = np.arange(start, start + len(res))
        return res

    return paged.groupBy(*keys, "page").applyInPandas(run, schema).withColumnRenamed("bk", "brand_key")


def pick_diverse(df: DataFrame, keys: Sequence[str], size: int = 36, brand_cap: int | Column = 8, overrides: dict[str, int] | None = None, priority: Column | None = None) -> DataFrame:
    """Category round-robin with a brand cap and brand|title de-duplication, priority rows first. The cap may be a column, such as that of an edit's
    brand policy, which is the same for all rows of a brand in a group.

    Before the sequential walk each category list is cut to what the walk can reach: one row per brand|title, at most the cap
    per brand, and 3·size rows — a walk of `size` picks can skip at most `size` saturated and `size` repeated rows, so nothing
    reachable is lost.
    """
    keys, overrides = list(keys), {k.lower(): v for k, v in (overrides or {}).items()}
    cap = brand_cap if isinstance(brand_cap, Column) else F.lit(brand_cap)
    for b, v in overrides.items():
        cap = F.when(F.lower("brand") == b, v).otherwise(cap)
    rows = df.select(*keys, "object_id", F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("brand", F.lit("")).alias("brand"),
                     F.concat_ws("|", F.lower("brand"), clean(C("title"))).alias("tk"), F.when(priority, 0).otherwise(1).alias("pr") if priority is not None else F.lit(0).alias("pr"),
                     "pos", cap.alias("cap"))
    cats = rows.groupBy(*keys, "category").agg(F.min(F.struct("pos", "object_id")).alias("f"))
    cats = cats.select(*keys, "category", C("f.pos").alias("cat_pos"), C("f.object_id").alias("cat_id"))
    rows = first_k(rows, [*keys, "category", "tk"], ["pr", "object_id"], 1).drop("rn")
    # a brand reaches at most `size` picks, whatever its cap
    rows = first_k(rows, [*keys, "category", "brand"], ["pr", "object_id"], size).where("rn <= cap").drop("rn")
    rows = first_k(rows, [*keys, "category"], ["pr", "object_id"], 3 * size).drop("rn").join(cats, [*keys, "category"])
    schema = rows.select(*keys, "object_id", "category", "brand").withColumn("slot", F.lit(1).cast("long")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cat_pos", "cat_id", "pr", "object_id"], kind="stable").reset_index(drop=True)
        lists = [list(g.index) for _, g in pdf.groupby("category", sort=False)]
        per_brand, seen, out = {}, set(), []
        brands, titles, caps = pdf["brand"].tolist(), pdf["tk"].tolist(), pdf["cap"].tolist()
        progress = True
        while progress and len(out) < size:
            progress = False
            for q in lists:
                if len(out) >= size:
                    break
                while q:
                    i = q.pop(0)
                    if per_brand.get(brands[i], 0) >= caps[i] or titles[i] in seen:
                        continue
                    seen.add(titles[i])
                    per_brand[brands[i]] = per_brand.get(brands[i], 0) + 1
                    out.append(i)
                    progress = True
                    break
        res = pdf.loc[out, [*keys, "object_id", "category", "brand"]].copy()
        res["slot"] = np.arange(1, len(res) + 1)
        return res

    return rows.groupBy(*keys).applyInPandas(run, schema)


def pick_topn_brandcap(df: DataFrame, keys: Sequence[str], top: int = 36, brand_cap: int = 4, kept: Column | None = None) -> DataFrame:
    """Kept ids first, then by score with at most `brand_cap` per brand (kept ones count), to `top`; exact with two windows."""
    rows = df.withColumn("__keep", F.when(kept, 0).otherwise(1) if kept is not None else F.lit(1))
    always = rows.where("__keep = 0")
    n_kept = always.groupBy(*keys, "brand").agg(F.count(F.lit(1)).alias("__nk"))
    rest = first_k(rows.where("__keep = 1"), [*keys, "brand"], [C("score").desc(), "object_id"], brand_cap, "__b").join(n_kept, [*keys, "brand"], "left")
    rest = rest.where(C("__b") + F.coalesce("__nk", F.lit(0)) <= brand_cap).select(*rows.columns)
    return first_k(always.unionByName(rest), keys, ["__keep", C("score").desc(), "object_id"], top, "slot").drop("__keep")


def brands_by_taste(users: DataFrame, brand_centroids: DataFrame, affinity: DataFrame, user: str = "user_token", penalty: float = 0.5) -> DataFrame:
    """All brands in the order of cosine × age multiplier, per user. users: (user, age_key, vec); centroids: (brand, vec)."""
    every = -1.1  # below any cosine
    # brands are few: they are what is sent to the tasks, users stay where they are
    pairs = topk.scored(brand_centroids.select("brand", "vec"), users.select(C(user).cast("string").alias("object_id"), "vec"), None, every, "brand")
    pairs = pairs.select(C("object_id").cast(users.schema[user].dataType).alias(user), F.coalesce(C("brand").cast("string"), F.lit("None")).alias("brand"), "score")
    ages = affinity.select("brand", "preferred_ages")
    joined = pairs.join(users.select(user, "age_key"), user).join(ages, "brand", "left")
    ok = C("age_key").isNull() | F.coalesce(F.array_contains("preferred_ages", C("age_key")), F.lit(True))
    value = joined.select(user, "brand", F.round(C("score") * F.when(ok, 1.0).otherwise(penalty), 9).alias("score"))
    return numbered(value, [user], [C("score").desc_nulls_last(), "brand"], "rank")


def similar_items(clusters: DataFrame, seeds: DataFrame, vectors: DataFrame, products: DataFrame, total_k: int = 120, per_category: int = 12, key: str = "user_token") -> DataFrame:
    """Neighbours of the seed clusters without the seeds, at most twelve per category."""
    near = topk.clustered(clusters, vectors, total_k, query_key=key).join(seeds.select(key, "object_id"), [key, "object_id"], "left_anti")
    return first_k(near.drop("rank").join(products.select("object_id", "category"), "object_id"), [key, "category"], [C("score").desc(), "object_id"], per_category, "rank")


def diverse_brand_pull(df: DataFrame, keys: Sequence[str], brands: int = 50, per_brand: int = 8, page: int = 0, size: int = 384, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The fifty largest brands of the scope, eight items each, one brand after the other in turn, one page of it."""
    counts = df.groupBy(*keys, "brand").agg(F.count(F.lit(1)).alias("__n"))
    top = first_k(counts, keys, [C("__n").desc(), "brand"], brands, "__b").drop("__n")
    items = first_k(df.join(top, [*keys, "brand"]), [*keys, "brand"], [*order, "object_id"], per_brand, "__i")
    ranked = numbered(items, keys, ["__i", "__b"], "new_pos", spread=None if keys else False)
    return ranked.where((C("new_pos") > page * size) & (C("new_pos") <= (page + 1) * size)).drop("__i", "__b")


def augment_pool(pool: DataFrame, semantic: DataFrame, boosts: DataFrame, products: DataFrame, keys: Sequence[str], boost_limit: int = 150) -> DataFrame:
    """Append neighbours of the text, then boosted ids, each only when new and in the catalogue."""
    id_keys = [*keys, "object_id"]
    catalogue = products.select("object_id")
    a = semantic.join(pool.select(*id_keys), id_keys, "left_anti").join(catalogue, "object_id", "left_semi")
    b = first_k(boosts, keys, ["rank"], boost_limit, "__b").drop("__b").join(pool.select(*id_keys), id_keys, "left_anti")
    b = b.join(a.select(*id_keys), id_keys, "left_anti").join(catalogue, "object_id", "left_semi")
    parts = [d.select(*id_keys, F.lit(i).alias("__src"), C(r).cast("long").alias("__r")) for i, (d, r) in enumerate(((pool, "pos"), (a, "rank"), (b, "rank")))]
    return numbered(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys, ["__src", "__r", "object_id"], "new_pos").drop("__src", "__r")


def insert_ahead(queue: DataFrame, fresh: DataFrame, keys: Sequence[str], current: Column, lookahead: int = 2, grid: bool = False, pos: str = "pos") -> DataFrame:
    """Keep rows up to current + 2, then unseen fresh rows; a grid keeps the whole queue and appends."""
    id_keys = [*keys, "object_id"]
    kept = queue if grid else queue.where(C(pos) <= current + lookahead + 1)
    new = fresh.join(kept.select(*id_keys), id_keys, "left_anti")
    both = kept.select(*id_keys, F.lit(0).alias("__s"), C(pos).alias("__p")).unionByName(new.select(*id_keys, F.lit(1).alias("__s"), C("rank").cast("long").alias("__p")))
    return numbered(both, keys, ["__s", "__p", "object_id"], "new_pos").drop("__s", "__p")


def edit_hydrate(edits: DataFrame, products: DataFrame, slug: str | None = None, featured: bool | None = None, columns: Sequence[str] = ("title", "brand")) -> DataFrame:
    """Edit ids in stored order with their products."""
    rows = edits
    if slug is not None:
        rows = rows.where(C("slug") == slug)
    if featured is not None:
        rows = rows.where(C("featured") == featured)
    ids = rows.select("slug", F.posexplode("product_ids").alias("pos", "object_id"))
    return ids.join(products.select("object_id", *columns), "object_id").select("slug", (C("pos") + 1).cast("long").alias("pos"), "object_id", *columns)


def flat_chunks(ranked: DataFrame, keys: Sequence[str], categories: Sequence[str] = tuple(vocab.CATEGORIES), pos: str = "pos") -> DataFrame:
    """A flat list cut into equal chunks, one per category; the last takes the rest."""
    n = with_group_stats(ranked, keys, __n=F.count(F.lit(1)))
    chunk = F.ceil(C("__n") / len(categories))
    i = F.least(F.floor((C(pos) - 1) / chunk), F.lit(len(categories) - 1))
    names = F.array(*[F.lit(c) for c in categories])
    return n.withColumn("chunk_category", F.get(names, i.cast("int"))).withColumn("chunk_pos", (C(pos) - i * chunk).cast("long")).drop("__n")


def outfit_fill(picks: DataFrame, candidates: DataFrame, keys: Sequence[str], size: int = 8, categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Valid picks (at most eight), padded from the candidates in category order; padding fills group A until it is one ahead
    of its picked size, then group B.

    picks: (keys, ord, object_id, outfit_group); candidates: (keys, category, rank, object_id)."""
    id_keys = [*keys, "object_id"]
    valid = picks.join(candidates.select(*id_keys).distinct(), id_keys, "left_semi")
    valid = first_k(valid, keys, ["ord", "object_id"], size, "slot").select(*id_keys, "slot", "outfit_group")
    stats = candidates.select(*keys).distinct().join(
        valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if(C("outfit_group") == "outfit_a").alias("__a")), list(keys), "left")
    ordinal = F.array_position(F.array(*[F.lit(c) for c in categories]), C("category"))
    pad = candidates.join(valid.select(*id_keys), id_keys, "left_anti").withColumn("__c", ordinal)
    pad = first_k(pad.groupBy(*id_keys).agg(F.min(F.struct("__c", "rank")).alias("__o")), keys, ["__o", "object_id"], size, "__i").join(stats, list(keys))
    n = F.coalesce("__n", F.lit(0))
    group = F.when(C("__i") == 1, "outfit_a").otherwise("outfit_b")
    pad = pad.where(C("__i") + n <= size).select(*id_keys, (C("__i") + n).alias("slot"), group.alias("outfit_group"))
    return valid.unionByName(pad)
