"""Text and URL column functions. All of them are built-in expressions except `decode_entities`."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from modiste import vocab


def lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable: it is evaluated once per row however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(col: Column) -> Column:
    """Trimmed lower-case text, '' for null."""
    return F.trim(F.lower(F.coalesce(col, F.lit(""))))


def filled(col: Column) -> Column:
    """Null instead of an empty string."""
    return F.when(col != "", col)


def any_word(words) -> str:
    """Substring alternation; the words are plain text."""
    return "|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ") for w in words)


def whole_words(alternation: str) -> str:
    """ASCII word boundaries around an alternation."""
    return rf"(?<![A-Za-z0-9_])(?:{alternation})(?![A-Za-z0-9_])"


def word_starts(words) -> str:
    return r"\b(?:" + any_word(words) + ")"


# ── categories and tags ───────────────────────────────────────────────────────
def category_from_title(title: Column, words=None, other: str | None = "other") -> Column:
    """First category, in order, having a keyword inside the title."""
    def first(text):
        out = None
        for category, kws in (words or vocab.FEED_CATEGORY_WORDS).items():
            hit = text.rlike(any_word(kws))
            out = F.when(hit, category) if out is None else out.when(hit, category)
        return out.otherwise(F.lit(other)) if other is not None else out

    return let(F.lower(F.coalesce(title, F.lit(""))), first)


def category_fallback(title: Column, description: Column, vendor_category: Column, words=None) -> Column:
    """Title, then description, then the vendor's own category as a slug, then 'other'."""
    words = words or vocab.JACKET_FIRST_CATEGORY_WORDS
    return F.coalesce(category_from_title(title, words, None), category_from_title(description, words, None),
                      filled(slugify(vendor_category)), F.lit("other"))


def category_from_breadcrumb(crumbs: Column, title: Column, steps=None, words=None) -> Column:
    """Vendor breadcrumb words in fixed order, then the title."""
    text = F.lower(F.array_join(F.coalesce(crumbs, F.array().cast("array<string>")), " "))
    out = None
    for category, kws in steps or vocab.BREADCRUMB_WORDS:
        hit = text.rlike(any_word(kws))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.coalesce(out, category_from_title(title, words or vocab.MARKETPLACE_CATEGORY_WORDS))


def aesthetic_tags(text: Column, aesthetics=None, colors=None, lengths=None) -> Column:
    """Aesthetic groups, then colours, then length words found in the text; distinct, in that order."""
    def found(low):
        parts = [F.when(reduce(lambda a, b: a | b, [low.contains(k) for k in kws]), tag) for tag, kws in (aesthetics or vocab.FEED_AESTHETICS).items()]
        for word in [*(vocab.TAG_COLORS if colors is None else colors), *(vocab.LENGTH_WORDS if lengths is None else lengths)]:
            parts.append(F.when(low.contains(word), word))
        return F.array(*parts)

    return F.array_distinct(F.array_compact(let(F.lower(F.coalesce(text, F.lit(""))), found)))


def is_mens(title: Column, description: Column | None = None, gender: Column | None = None, tags: Column | None = None,
            product_type: Column | None = None, mode: str = "phrase", head: int | None = 120) -> Column:
    """Menswear test. `phrase`: gender or a whole-word phrase in title + description head; `words`: a whole word from the
    list; `substring`: the list as substrings, which also hits 'women' (kept for parity)."""
    t = F.lower(F.coalesce(title, F.lit("")))
    if mode == "substring":
        hit = t.rlike(any_word(vocab.MENS_WORDS))
        if product_type is not None:
            hit = hit | F.lower(F.coalesce(product_type, F.lit(""))).rlike(any_word(vocab.MENS_WORDS))
        if tags is not None:
            hit = hit | F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x).isin(vocab.MENS_WORDS))
        return hit
    text = t
    if description is not None:
        d = F.coalesce(description, F.lit(""))
        text = F.concat(t, F.lit(" "), F.lower(d if head is None else F.substring(d, 1, head)))
    if mode == "words":
        return text.rlike(whole_words("|".join(vocab.MENS_WORDS)))
    hit = text.rlike(vocab.MENS_PHRASE)
    return hit if gender is None else F.coalesce(gender == "male", F.lit(False)) | hit


# ── markup ────────────────────────────────────────────────────────────────────
def strip_html(col: Column, limit: int | None = 500) -> Column:
    out = F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", " ")
    return out if limit is None else F.substring(out, 1, limit)


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    hexa, dec, named = re.compile(r"&#x([0-9a-fA-F]+);"), re.compile(r"&#(\d+);"), re.compile(r"&([a-zA-Z]+);")
    escaped = re.compile(r"\\u([0-9a-fA-F]{4})")

    def one(text):
        if text is None:
            return None
        text = hexa.sub(lambda m: html.unescape(m.group(0)), text)
        text = dec.sub(lambda m: html.unescape(m.group(0)), text)
        text = named.sub(lambda m: vocab.NAMED_ENTITIES.get(m.group(1), m.group(0)), text)
        return escaped.sub(lambda m: chr(int(m.group(1), 16)), text)

    return s.map(one, na_action="ignore")


def decode_entities(col: Column) -> Column:
    """Hex, decimal and named entities plus \\uXXXX escapes. Rows without '&' or a backslash never reach Python's decoder."""
    marked = col.rlike(r"[&\\\\]")
    return F.when(marked, _decode(F.when(marked, col))).otherwise(col)


# ── URLs and ids ──────────────────────────────────────────────────────────────
def clean_image_url(url: Column, host: str = "cdn.shopify.com") -> Column:
    """Drop the query string, on one image host only."""
    return F.when(url.startswith("http") & url.contains(host), F.split_part(url, F.lit("?"), F.lit(1))).otherwise(url)


def slugify(col: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def domain_prefix(domain: Column) -> Column:
    return F.regexp_replace(F.coalesce(domain, F.lit("unknown")), "(?i)[^a-z0-9]", "")


def object_id(prefix: str, domain: Column, raw_id: Column, slug: bool = False, limit: int = 120) -> Column:
    """`prefix-domain-id`; html ids are slugged and cut to `limit` characters."""
    raw = raw_id.cast("string")
    out = F.concat(F.lit(prefix + "-"), domain_prefix(domain), F.lit("-"), slugify(raw) if slug else raw)
    return F.substring(out, 1, limit) if slug else out


def host_of(url: Column) -> Column:
    """Host name without `www.`; null for text that is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def retailer_name(domain: Column) -> Column:
    """Known shop name, else the title-cased first label of the host without `www.` and two-letter prefixes."""
    names = F.create_map(*[F.lit(x) for kv in vocab.RETAILER_NAMES.items() for x in kv])
    host = F.regexp_replace(domain, r"^(?:www\.|[a-z]{2}\.)+", "")
    label = F.split_part(F.regexp_replace(host, r"\.com.*$", ""), F.lit("."), F.lit(1))
    titled = F.initcap(F.regexp_replace(label, "-", " "))
    return F.when(F.coalesce(domain, F.lit("")) == "", "Shop").otherwise(F.coalesce(F.try_element_at(names, host), titled))


def brand_domain_candidates(name: Column, tlds=None) -> Column:
    """Brand name to slug bases times top-level domains, distinct."""
    ascii_name = F.translate(name, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
                             "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    s = F.split_part(ascii_name, F.lit("|"), F.lit(1))
    s = F.lower(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))
    s = F.regexp_replace(s, "&", "and")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[.,'’!?®™\"]", ""), r"[^a-z0-9\s+-]", ""))

    def edge(c):
        return F.regexp_replace(c, "^-+|-+$", "")

    def bare(c):
        return F.regexp_replace(c, "(the|studios?|collection|official|store|label)$", "")

    concat, dashed = edge(F.regexp_replace(s, r"\s+", "")), edge(F.regexp_replace(s, r"\s+", "-"))
    bases = F.filter(F.array_distinct(F.array(concat, dashed, bare(concat), bare(dashed), F.regexp_replace(concat, "-", ""))),
                     lambda b: F.length(b) >= 3)
    return F.array_distinct(F.flatten(F.transform(bases, lambda b: F.transform(lit_array(tlds or vocab.PROBE_TLDS), lambda t: F.concat(b, t)))))


# ── language ──────────────────────────────────────────────────────────────────
def display_text(english: Column, original: Column) -> Column:
    return F.coalesce(filled(F.trim(english)), original)


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII characters; 1 for empty text."""
    t = F.coalesce(text, F.lit(""))
    kept = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    return F.when(F.length(t) == 0, F.lit(1.0)).otherwise(kept / F.length(t))


def english_hits(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(whole_words("|".join(vocab.ENGLISH_WORDS))))


def looks_english(title: Column, description: Column, head: int | None = 400, min_ascii: float = 0.97, min_hits: int = 3) -> Column:
    """ASCII share and lexicon hits; a short text passes on two tokens of which half are in the lexicon."""
    t, d = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    text = F.concat(t, F.lit(" "), d if head is None else F.substring(d, 1, head))
    tokens = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    known = let(english_hits(text), lambda hits: (hits >= min_hits) | ((F.length(d) < 30) & (tokens >= 2) & (hits >= 0.5 * tokens)))
    return F.when(F.trim(text) == "", True).when(ascii_ratio(text) < min_ascii, False).otherwise(known)


# ── query building ────────────────────────────────────────────────────────────
def tokens(text: Column) -> Column:
    return F.filter(F.split(clean(text), r"\s+"), lambda x: x != "")


def edit_seed_query(title: Column, subtitle: Column, limit: int = 8) -> Column:
    """First eight words longer than two characters of title + subtitle."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.concat_ws(" ", title, subtitle)), r"[^a-z0-9\s-]", " "), r"\s+"),
                     lambda w: F.length(w) > 2)
    return F.array_join(F.slice(words, 1, limit), " ")


def _listed(items: Column) -> Column:
    n = F.size(items)
    return F.when(n == 1, F.get(items, 0)).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(items, n - 1)))


def aesthetic_sentence(aesthetic: Column, colors: Column, silhouettes: Column) -> Column:
    """The templated sentence; null when there is nothing to say."""
    a = F.trim(F.coalesce(aesthetic, F.lit("")))
    cols = F.filter(F.slice(colors, 1, 3), lambda x: x != "")
    sils = F.filter(F.slice(silhouettes, 1, 2), lambda x: x != "")
    sentence = F.concat(F.lit("a photo of "), F.when(a != "", F.concat(F.lit("a "), a, F.lit(" outfit"))).otherwise("an outfit"),
                        F.when(F.size(cols) > 0, F.concat(F.lit(" in "), _listed(cols))).otherwise(""),
                        F.when(F.size(sils) > 0, F.concat(F.lit(" with "), F.array_join(sils, " and "))).otherwise(""))
    return F.when((a != "") | (F.size(cols) > 0) | (F.size(sils) > 0), sentence)


def vibe_phrases(phrases: Column, aesthetic: Column, colors: Column, silhouettes: Column, limit: int = 8) -> Column:
    """The retrieval phrases, else the templated sentence."""
    own = F.filter(F.transform(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(own) > 0, F.slice(own, 1, limit)).otherwise(
        F.array_compact(F.array(aesthetic_sentence(aesthetic, colors, silhouettes))))


def prompt_template(text: Column, prefix: str = "a photo of ") -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when((t == "") | t.rlike(r"(?i)^a\s+(photo|picture|image)\s+of\b"), t).otherwise(F.concat(F.lit(prefix), t))


def query_augment(seed: Column, palette: Column, terms: Column) -> Column:
    """Seed queries plus (last palette word x category term); an empty seed stays empty."""
    last = F.transform(F.slice(palette, 1, 4), lambda c: F.element_at(F.split(F.lower(c), " "), -1))
    colors = F.filter(last, lambda c: (F.length(c) > 2) & ~c.rlike("^[0-9]"))
    extra = F.flatten(F.transform(colors, lambda c: F.transform(terms, lambda t: F.concat(c, F.lit(" "), t))))
    return F.when(F.size(seed) > 0, F.concat(seed, extra)).otherwise(F.array().cast("array<string>"))


def dna_hash(*fields: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(F.lower(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])).cast("binary")), 1, size)


def migrate_label_keys(labels: Column, old=("age-32-40", "age-40-60"), new: str = "age-32-plus") -> Column:
    """Fold old keys into one; distinct, first position kept."""
    return F.array_distinct(F.transform(labels, lambda x: F.when(x.isin(list(old)), F.lit(new)).otherwise(x)))
