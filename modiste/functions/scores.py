"""Price, dwell, recency and enrichment column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from modiste import vocab


def js_round(c: Column) -> Column:
    """Half-up rounding towards +infinity."""
    return F.floor(c + 0.5)


def parse_price(text: Column) -> Column:
    """Leading number of the text with everything but digits and dots removed; null when there is none."""
    return F.regexp_extract(F.regexp_replace(text, "[^0-9.]", ""), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def price_bucket(price: Column, mid: float = 50, luxury: float = 150, zero_unknown: bool = True) -> Column:
    unknown = price.isNull() | (price == 0) if zero_unknown else price.isNull()
    return F.when(unknown, "unknown").when(price < mid, "budget").when(price < luxury, "mid").otherwise("luxury")


def fx_price(price: Column, rate: Column) -> Column:
    """Rounded dollars; null for a missing or non-positive price."""
    return F.when(price > 0, js_round(price * rate).cast("double"))


def price_tier_match(price: Column, bucket: Column, tier: str) -> Column:
    """Tier by price, else by coarse bucket; no bucket passes."""
    if tier == "all":
        return F.lit(True)
    by_price = {"under100": price < 100, "100to300": (price >= 100) & (price < 300),
                "300to1000": (price >= 300) & (price < 1000), "over1000": price >= 1000}[tier]
    wanted = {"under100": "budget", "100to300": "mid", "300to1000": "luxury", "over1000": "luxury"}[tier]
    b = F.lower(F.coalesce(bucket, F.lit("")))
    return F.when(price.isNotNull(), by_price).otherwise((b == "") | (b == wanted))


def dwell_score(ms: Column, low: float = 500, high: float = 8000) -> Column:
    return F.when(ms <= low, F.lit(0.0)).when(ms >= high, F.lit(1.0)).otherwise(F.log(ms / low) / math.log(high / low))


def dwell_bucket(ms: Column) -> Column:
    return F.when(ms > 7000, "strong_positive").when(ms > 2500, "positive").when(ms > 700, "neutral").otherwise("negative")


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86400e6)


def recency_weight(ts: Column, as_of: Column, half_life_days: float = 30) -> Column:
    """Half every 30 days; a missing or future time weighs 1."""
    return F.coalesce(F.exp(F.greatest(age_days(ts, as_of), F.lit(0.0)) * (-math.log(2) / half_life_days)), F.lit(1.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (`greatest` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


ENRICHMENT_SCHEMA = (
    "attributes STRUCT<silhouette: STRING, fabric: STRING, pattern: STRING, neckline: STRING, length: STRING, mood: STRING, "
    "aesthetic_tags: ARRAY<STRING>>, style_axes STRUCT<formality: STRING, minimalism: STRING, edge: STRING, romance: STRING, "
    "drape: STRING>, caption STRING"
)


def normalize_enrichment(raw_json: Column) -> Column:
    """Defaults, lower case, axes clamped to [0,1] (0.5 when bad), at most four tags, caption up to 300 characters."""
    r = F.from_json(raw_json, ENRICHMENT_SCHEMA)
    a = r["attributes"]
    defaults = {"silhouette": "other", "fabric": "other", "pattern": "solid", "neckline": "none", "length": "n/a", "mood": "casual"}
    fields = [F.lower(F.coalesce(a[k], F.lit(d))).alias(k) for k, d in defaults.items()]
    fields.append(F.slice(F.transform(F.coalesce(a["aesthetic_tags"], F.array().cast("array<string>")), F.lower), 1, 4).alias("aesthetic_tags"))
    fields += [F.coalesce(clamp(r["style_axes"][k].try_cast("double"), 0, 1), F.lit(0.5)).alias(k) for k in vocab.AXES]
    fields.append(F.substring(F.trim(F.coalesce(r["caption"], F.lit(""))), 1, 300).alias("caption"))
    return F.when(r.isNotNull(), F.struct(*fields))


def sanitize_axis_deltas(deltas: Column) -> Column:
    """Known axes only, clamped to [-1, 1]."""
    kept = F.map_filter(deltas, lambda k, v: k.isin(vocab.AXES) & v.isNotNull() & ~F.isnan(v))
    return F.transform_values(kept, lambda k, v: clamp(v, -1, 1))
