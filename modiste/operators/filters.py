"""Filters: same columns in and out. Rules are compiled into column expressions; id filters are semi/anti joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import text
from modiste.scale import without

C = F.col


def image_valid(df: DataFrame, col: str = "image_url", mode: str = "length") -> DataFrame:
    """`length`: longer than 20 and no blank/placeholder; `http`: an http URL and no placeholder."""
    u = F.coalesce(C(col), F.lit(""))
    if mode == "http":
        return df.where(u.startswith("http") & ~u.contains("placeholder"))
    return df.where((F.length(u) > 20) & ~u.contains("blank.gif") & ~u.contains("placeholder"))


def allowed_bands(band: Column) -> Column:
    """Price buckets that satisfy a requested one; null asks for nothing."""
    return (F.when(band == "budget", text.lit_array(["budget"])).when(band == "luxury", text.lit_array(["luxury", "mid"]))
            .when(band.isNotNull(), text.lit_array(["mid", "budget"])))


def price_band(df: DataFrame, band: Column | str | None, col: str = "price_range") -> DataFrame:
    if band is None:
        return df
    if isinstance(band, str):
        names = {"budget": ["budget"], "luxury": ["luxury", "mid"]}.get(band, ["mid", "budget"])
        return df.where(C(col).isin(names))
    return df.where(band.isNull() | F.array_contains(allowed_bands(band), C(col)))


def axis_range(df: DataFrame, axes: dict[str, float | tuple[float, float]], band: str | None = None,
               categories: Sequence[str] | None = None) -> DataFrame:
    """A number is a lower bound, a pair a closed range; all parts must hold."""
    parts = [C(a).between(*r) if isinstance(r, tuple) else C(a) >= r for a, r in axes.items()]
    if categories:
        parts.append(C("category").isin(list(categories)))
    out = df.where(reduce(lambda x, y: x & y, parts)) if parts else df
    return price_band(out, band)


def min_score(df: DataFrame, floor: float, col: str = "score") -> DataFrame:
    return df.where(C(col) >= floor)


def price_max(df: DataFrame, cap: float | None, col: str = "price") -> DataFrame:
    """At most `cap`; rows without a price pass; no cap or a non-positive one filters nothing."""
    return df if cap is None or cap <= 0 else df.where(C(col).isNull() | (C(col) <= cap))


def compose(*conditions: Column | None) -> Column:
    """AND of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def steer_post(df: DataFrame, steer: str = "steer") -> DataFrame:
    """Lenient steer filter on a struct column: a row fails only on a field it has."""
    s, empty = C(steer), F.array().cast("array<string>")

    def terms(name, longer_than=0):
        return F.filter(F.transform(F.coalesce(s[name], empty), lambda x: F.trim(F.lower(x))), lambda x: F.length(x) > longer_than)

    cats, cols, avoids = terms("categories"), terms("colors"), terms("avoid_terms", 2)
    bucket, cat, col = text.clean(C("price_range")), text.clean(C("category")), text.clean(C("color"))
    hay = F.lower(F.concat_ws(" ", *[c for c in ("title", "title_en", "description", "description_en", "category", "color", "material") if c in df.columns],
                              *(["aesthetic_tags"] if "aesthetic_tags" in df.columns else [])))
    keep = (
        (s["price_range"].isNull() | (bucket == "") | (bucket == s["price_range"]))
        & ((F.size(cats) == 0) | (cat == "") | F.exists(cats, lambda x: cat.contains(x) | x.contains(cat)))
        & ((F.size(cols) == 0) | (col == "") | F.exists(cols, lambda x: col.contains(x)))
        & ~F.exists(avoids, lambda x: hay.contains(x))
    )
    return df.where(s.isNull() | keep)


def avoid_words(phrases: Column) -> Column:
    """Words longer than three letters of the avoid phrases."""
    words = F.flatten(F.transform(phrases, lambda p: F.split(F.regexp_replace(F.lower(p), r"[^a-z\s]", ""), r"\s+")))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def holds_avoided(phrases: Column, fields: Sequence[str], split: bool = True) -> Column:
    """Whether the text of the fields contains an avoid word."""
    hay = F.lower(F.concat_ws(" ", *fields))
    words = avoid_words(phrases) if split else F.filter(F.transform(phrases, F.lower), lambda w: F.length(w) > 0)
    return F.exists(F.coalesce(words, F.array().cast("array<string>")), lambda w: hay.contains(w))


def avoid_keywords(df: DataFrame, phrases: Column, fields: Sequence[str] = ("title", "description", "material", "color", "aesthetic_tags"),
                   split: bool = True) -> DataFrame:
    """Drop rows whose text contains an avoid word; the words come with the row, so no pair join is needed."""
    return df.where(~holds_avoided(phrases, [f for f in fields if f in df.columns], split))


def mens(df: DataFrame, head: int | None = 120) -> DataFrame:
    gender = C("gender") if "gender" in df.columns else None
    return df.where(~text.is_mens(C("title"), C("description"), gender, head=head))


def _blocked(words: dict, key: Column, title: Column) -> Column:
    hit = F.lit(False)
    for name, kws in words.items():
        hit = hit | ((key == name) & title.rlike(text.word_starts(kws)))
    return hit


def category_blockers(df: DataFrame, lane: str = "lane", blockers=None, expected=None, knit_words=None) -> DataFrame:
    """Keep the rows that belong in their lane: no blocked title word, the expected category, a knit word for knits, no core
    category for 'other'."""
    key, title, cat = F.lower(F.trim(C(lane))), F.lower(F.coalesce(C("title"), F.lit(""))), text.clean(C("category"))
    blockers = vocab.LANE_TITLE_BLOCKERS if blockers is None else blockers
    expected = vocab.CATEGORY_SLUGS if expected is None else expected
    wrong = F.lit(False)
    for name, category in expected.items():
        wrong = wrong | ((key == name) & (cat != "") & (cat != category))
    not_knit = (key == "knits") & ~title.rlike(text.word_starts(knit_words or vocab.KNIT_TITLE_WORDS))
    core = (key == "other") & cat.isin(vocab.CATEGORIES)
    return df.where(~_blocked(blockers, key, title) & ~wrong & ~not_knit & ~core)


def focus_skew(df: DataFrame, focus: Column, blockers=None) -> DataFrame:
    """Only focus categories stay, blocker-filtered; an empty focus changes nothing."""
    wanted = F.transform(F.coalesce(focus, F.array().cast("array<string>")), lambda c: F.trim(F.lower(c)))
    title = F.lower(F.coalesce(C("title"), F.lit("")))
    ok = F.array_contains(wanted, C("category")) & ~_blocked(blockers or vocab.FOCUS_TITLE_BLOCKERS, C("category"), title)
    return df.where((F.size(wanted) == 0) | ok)


def disliked(df: DataFrame, brands: DataFrame, categories: DataFrame, key: str = "user_token") -> DataFrame:
    """Drop rows whose brand or category the user dislikes: one anti join per attribute."""
    return df.join(brands, [key, "brand"], "left_anti").join(categories, [key, "category"], "left_anti")


def title_allow_block(df: DataFrame, allow=None, block=None) -> DataFrame:
    """Per-category allow and block lists on word starts of the title; a category without a list passes."""
    allow, block = allow or vocab.INDEX_TITLE_ALLOW, block or vocab.INDEX_TITLE_BLOCK
    title = F.lower(C("title"))
    ok = ~C("category").isin(list(allow)) | _blocked(allow, C("category"), title)
    return df.where(ok & ~_blocked(block, C("category"), title))


def board_relevant(df: DataFrame, *cols: str, words=None) -> DataFrame:
    return df.where(F.lower(F.concat_ws(" ", *cols)).rlike(text.any_word(words or vocab.BOARD_WORDS)))


def pin_nonclothing(df: DataFrame, *cols: str, words=None) -> DataFrame:
    """Drop pins about something else; empty text passes."""
    return df.where(~F.lower(F.concat_ws(" ", *cols)).rlike(text.any_word(words or vocab.NON_CLOTHING_WORDS)))


def edit_condition(categories: Sequence[str], tests, policy: dict | None = None) -> Column:
    """Whether a row belongs to an edit: its category, the tests it must and mustn't match, and the edit's brand policy. Accepted brands needn't pass the
    tests that must match; allow-listed brands are named exactly, excluded ids drop out."""
    policy = policy or {}
    parts = {k: text.clean(C(name)) if k == "c" else F.lower(F.coalesce(C(name), F.lit("")))
             for k, name in (("t", "title"), ("c", "color"), ("m", "material"), ("d", "description"))}
    ok = C("category").isin(list(categories)) if categories else F.lit(True)
    if policy.get("only"):
        ok = ok & F.coalesce(C("brand").isin(list(policy["only"])), F.lit(False))
    if policy.get("exclude"):
        ok = ok & ~C("object_id").isin(list(policy["exclude"]))
    required = F.lit(True)
    for must, field, pattern in tests:
        gate = None
        if field in ("c?", "!c"):
            gate = parts["c"] == "" if field == "c?" else parts["c"] != ""
            hit = parts["c" if field == "c?" else "t"].rlike(pattern)
        elif "|" in field:
            hit = reduce(lambda a, b: a | b, [parts[f].rlike(pattern) for f in field.split("|")])
        else:
            hit = F.concat_ws(" ", *[parts[f] for f in field]).rlike(pattern)
        test = hit if must else ~hit
        test = test if gate is None else gate | test
        required, ok = (required & test, ok) if must else (required, ok & test)
    if policy.get("accept"):
        required = required | F.lower(F.coalesce("brand", F.lit(""))).isin([x.lower() for x in policy["accept"]])
    return ok & required


def edit_rules(df: DataFrame, rules=None, out: str = "edit", policies: dict | None = None) -> DataFrame:
    """One row per (product, edit it belongs to): the rule list becomes one array expression, so each row is read once."""
    policies = vocab.EDIT_POLICIES if policies is None else policies
    slugs = [F.when(edit_condition(cats, tests, policies.get(slug)), slug) for slug, cats, tests in rules or vocab.EDIT_RULES]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*slugs))))


def edit_places(df: DataFrame, policies: dict | None = None, edit: str = "edit", cap: str = "brand_cap", first: str = "comes_first") -> DataFrame:
    """Add the brand's cap in the row's edit and whether the row comes first in its category there."""
    policies = vocab.EDIT_POLICIES if policies is None else policies
    brand, title = F.lower(F.coalesce("brand", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    caps, ahead = F.lit(vocab.EDIT_BRAND_CAP), F.lit(False)
    for slug, policy in policies.items():
        here = C(edit) == slug
        for name, n in policy.get("caps", {}).items():
            caps = F.when(here & (brand == name.lower()), n).otherwise(caps)
        if policy.get("first"):
            ahead = ahead | (here & brand.isin([x.lower() for x in policy["first"]]))
        if policy.get("first_title"):
            ahead = ahead | (here & title.rlike(policy["first_title"]))
    return df.withColumn(cap, caps).withColumn(first, ahead)


def vision_reason(allowed: Sequence[str], excludes: Sequence[str], allowed_brands: Sequence[str] = ()) -> Column:
    """First reason to drop a row, null for survivors."""
    body = F.lower(F.concat_ws(" ", "title", "description", "color"))
    ok = C("category").isin(list(allowed))
    if allowed_brands:
        ok = ok | C("brand").isin(list(allowed_brands))
    reason = F.when(~ok, F.concat(F.lit("category:"), C("category")))
    for pattern in excludes:
        reason = reason.when(body.rlike(pattern), "excl:" + pattern[:30])
    return reason


def vision_rules(df: DataFrame, allowed, excludes, allowed_brands=()) -> tuple[DataFrame, DataFrame]:
    """(survivors, drop counts per reason)."""
    tagged = df.withColumn("reason", vision_reason(allowed, excludes, allowed_brands))
    return tagged.where(C("reason").isNull()).drop("reason"), tagged.where(C("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def image_verdict(width: Column, height: Column, blur: Column, entropy: Column) -> Column:
    ratio = width / height
    return (F.when((width < vocab.MIN_DIM) | (height < vocab.MIN_DIM), "lowRes")
            .when((ratio > vocab.MAX_RATIO) | (ratio < 1 / vocab.MAX_RATIO), "tallBanner")
            .when(blur < vocab.BLUR_THRESHOLD, "blurry").when(entropy < vocab.ENTROPY_THRESHOLD, "flatGraphic").otherwise("pass"))


def exclude_ids(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return without(df, seen, keys)


def handle_skip(df: DataFrame, handle: str = "handle", words=None) -> DataFrame:
    return df.where(~F.lower(C(handle)).rlike(text.any_word(words or vocab.SKIP_HANDLE_WORDS)))
