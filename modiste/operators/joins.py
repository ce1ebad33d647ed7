"""Joins. No join here emits all pairs of a group: theta joins go through an equi-join on a selective token or time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions.text import tokens
from modiste.operators.filters import image_valid
from modiste.scale import first_k, without

C = F.col


def hydrate_inner(ids: DataFrame, products: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ranked ids joined to the catalogue late: only the needed columns travel; misses and bad images are dropped."""
    wanted = image_valid(products.select("object_id", *dict.fromkeys([*columns, "image_url"])), mode="http")
    return ids.join(wanted, "object_id").select(*ids.columns, *columns)


def vectors_left(candidates: DataFrame, visual: DataFrame, vibe: DataFrame) -> DataFrame:
    return (candidates.join(visual.select("object_id", C("vec").alias("visual")), "object_id", "left")
            .join(vibe.select("object_id", C("vec").alias("vibe")), "object_id", "left"))


def fetch_ordered_left(ids: DataFrame, vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every id keeps its position; vector and metadata may be missing."""
    return ids.join(vectors, "object_id", "left").join(metadata, "object_id", "left")


def semi_filter(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids, list(keys), "left_semi")


def anti_seen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return without(df, seen, keys)


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def brand_dim(products: DataFrame, affinity: DataFrame) -> DataFrame:
    """Add `preferred_ages` from the brand's entry, else from the retailer's."""
    dim = affinity.where(F.size("preferred_ages") > 0).select(_squash(C("brand")).alias("__key"), "preferred_ages")
    by_brand = dim.select(C("__key").alias("__b"), C("preferred_ages").alias("__by_brand"))
    by_shop = dim.select(C("__key").alias("__r"), C("preferred_ages").alias("__by_shop"))
    joined = (products.join(by_brand, _squash(C("brand")) == C("__b"), "left").join(by_shop, _squash(C("retailer")) == C("__r"), "left"))
    return joined.select(*products.columns, F.coalesce("__by_brand", "__by_shop").alias("preferred_ages"))


def age_matches(preferred: Column, age: Column) -> Column:
    """No age or no entry is neutral."""
    return F.coalesce(F.array_contains(preferred, age), F.lit(True))


def token_theta(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """Pairs where every token of `right_text` occurs in `left_text`. Each right row is looked up by its rarest token only,
    then the other tokens are verified on the joined row."""
    r = right.withColumn("__need", F.array_distinct(tokens(C(right_text)))).where(F.size("__need") > 0)
    freq = left.select(F.explode(F.array_distinct(tokens(C(left_text)))).alias("__tok")).groupBy("__tok").agg(F.count(F.lit(1)).alias("__df"))
    # rows with one text share their rarest token, so the text is all that is looked up
    anchors = (r.select(C(right_text).alias("__text"), F.explode("__need").alias("__tok")).distinct().join(freq, "__tok", "left")
               .groupBy("__text").agg(F.min_by("__tok", F.struct(F.coalesce("__df", F.lit(0)), C("__tok"))).alias("__anchor")))
    anchored = r.join(anchors, C(right_text) == C("__text")).drop("__text")
    l = left.withColumn("__have", F.array_distinct(tokens(C(left_text)))).withColumn("__anchor", F.explode("__have"))
    return (l.join(anchored, "__anchor").where(F.size(F.array_except("__need", "__have")) == 0)
            .drop("__anchor", "__need", "__have"))


def rule_hit(title: Column, category: Column, rules=None) -> Column:
    """First matching rule of a bounded rule list as one struct expression (name, action, target); no join."""
    t, c = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.coalesce(category, F.lit("")))
    out = None
    for name, pattern, excuse, wrong, target in rules or vocab.AUDIT_RULES:
        hit = c.isin(list(wrong)) & t.rlike(pattern)
        if excuse:
            hit = hit & ~t.rlike(excuse)
        value = F.struct(F.lit(name).alias("rule"), F.lit("recategorize" if target else "delete").alias("action"),
                         F.lit(target).cast("string").alias("target"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def rule_theta(products: DataFrame, rules=None) -> DataFrame:
    return products.withColumn("hit", rule_hit(C("title"), C("category"), rules)).where(C("hit").isNotNull()).select(*products.columns, "hit.*")


def pairs(high: DataFrame, low: DataFrame, keys: Sequence[str] = ("category", "axis"), rn: str = "rn") -> DataFrame:
    """Pair the n-th high item with the n-th low item of a cell."""
    h = high.select(*keys, rn, C("object_id").alias("high_id"))
    return h.join(low.select(*keys, rn, C("object_id").alias("low_id")), [*keys, rn]).where("high_id <> low_id")


def asof_latest(events: DataFrame, steers: DataFrame, user: str = "user_token", within_minutes: int = 30, payload: str = "steer_id") -> DataFrame:
    """Latest earlier-or-equal steer of the same user within the window, per event.

    Rows are placed in time buckets of the window's width; each bucket is handed the last steer of the bucket before it, so a
    bucket answers its own events. A busy user is spread over its buckets and every row is read once.
    """
    width = within_minutes * 60_000_000
    def bucketed(df):
        return df.withColumn("__us", F.unix_micros("ts")).withColumn("__b", F.floor(C("__us") / width))

    s = bucketed(steers).select(user, "__b", "__us", F.col(payload))
    last = s.groupBy(user, "__b").agg(F.max(F.struct("__us", payload)).alias("__l"))
    carried = last.select(user, (C("__b") + 1).alias("__b"), "__l.*")
    marks = s.unionByName(carried).select(user, "__b", "__us", F.lit(0).alias("__kind"), F.struct("__us", payload).alias("__steer"), F.lit(None).cast("long").alias("event_id"))
    ev = bucketed(events).select(user, "__b", "__us", F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__steer"].dataType).alias("__steer"), "event_id")
    w = Window.partitionBy(user, "__b").orderBy("__us", "__kind", F.coalesce(C("__steer")[payload], F.lit(0)))
    seen = marks.unionByName(ev).withColumn("__last", F.last("__steer", ignorenulls=True).over(w)).where("__kind = 1")
    ok = C("__us") - C("__last.__us") <= width
    return seen.select("event_id", user, F.when(ok, C("__last")[payload]).alias(payload), F.when(ok, C("__us") - C("__last.__us")).alias("lag_us"))


def seen_without_click(signals: DataFrame, min_sessions: int = 2) -> DataFrame:
    """(user, object) shown in several sessions and never clicked; one aggregate per level, no self join."""
    per_session = signals.groupBy("user_token", "object_id", "session_id").agg(
        F.max(C("kind") == "impression").alias("seen"), F.max(C("kind") == "click").alias("clicked"))
    per_item = per_session.groupBy("user_token", "object_id").agg(F.count_if("seen").alias("sessions"), F.max("clicked").alias("clicked"))
    return per_item.where(~C("clicked") & (C("sessions") >= min_sessions)).select("user_token", "object_id", "sessions")


def feedback_exclude(candidates: DataFrame, signals: DataFrame, min_sessions: int = 2) -> DataFrame:
    return candidates.join(seen_without_click(signals, min_sessions), ["user_token", "object_id"], "left_anti")


def mean_vs_label(picks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Picked and rejected vectors of each pair; a pair missing either side is dropped."""
    v = vectors.select("object_id", "vec")
    a = v.select(C("object_id").alias("picked"), C("vec").alias("picked_vec"))
    b = v.select(C("object_id").alias("rejected"), C("vec").alias("rejected_vec"))
    return picks.join(a, "picked").join(b, "rejected")


def first_rule(df: DataFrame, keys: Sequence[str], ordinal: str = "ord") -> DataFrame:
    return first_k(df, keys, [ordinal], 1).drop("rn")
