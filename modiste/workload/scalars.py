"""Registered queries of the projection and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import scores, steer, text
from modiste.plans.retrieval import classify_queries
from modiste.workload.fixtures import AS_OF, query, quoted, r6, r6c

C = F.col


def rx(words) -> str:
    return quoted(text.any_word(words))


def case_words(col: str, words: dict, other: str = "'other'") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {rx(kws)}) THEN '{cat}'" for cat, kws in words.items()) + f" ELSE {other} END"


def in_list(words) -> str:
    return ", ".join(quoted(w) for w in words)


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("fn_parse_price", """SELECT object_id, TRY_CAST(regexp_extract(regexp_replace(raw, '[^0-9.]', '', 'g'), '^(\\d+\\.?\\d*|\\.\\d+)', 1) AS DOUBLE) AS price
    FROM (SELECT object_id, CASE WHEN price IS NULL THEN 'sold out' WHEN price < 100 THEN concat('US$ ', CAST(pos AS VARCHAR), '.50.9')
          ELSE concat('.', CAST(pos AS VARCHAR), ' EUR') END AS raw FROM products)""")
def _(e):
    raw = (F.when(C("price").isNull(), "sold out").when(C("price") < 100, F.concat(F.lit("US$ "), C("pos").cast("string"), F.lit(".50.9")))
           .otherwise(F.concat(F.lit("."), C("pos").cast("string"), F.lit(" EUR"))))
    return e.products.select("object_id", scores.parse_price(raw).alias("price"))


@query("fn_price_bucket", """SELECT object_id,
    CASE WHEN price IS NULL OR price = 0 THEN 'unknown' WHEN price < 50 THEN 'budget' WHEN price < 150 THEN 'mid' ELSE 'luxury' END AS feed,
    CASE WHEN price IS NULL OR price = 0 THEN 'unknown' WHEN price < 50 THEN 'budget' WHEN price < 200 THEN 'mid' ELSE 'luxury' END AS marketplace,
    CASE WHEN price IS NULL THEN 'unknown' WHEN price < 50 THEN 'budget' WHEN price < 150 THEN 'mid' ELSE 'luxury' END AS null_only
    FROM products""")
def _(e):
    p = C("price")
    return e.products.select("object_id", scores.price_bucket(p).alias("feed"), scores.price_bucket(p, luxury=200).alias("marketplace"),
                             scores.price_bucket(p, zero_unknown=False).alias("null_only"))


FX = {"Brand#1": 0.012, "Brand#2": 0.272, "Brand#3": 1.27}


@query("fn_fx_normalize", """SELECT object_id, usd, CASE WHEN usd = 0 THEN 'unknown' WHEN usd < 50 THEN 'budget' WHEN usd < 150 THEN 'mid' ELSE 'luxury' END AS bucket
    FROM (SELECT object_id, floor(price * CASE brand WHEN 'Brand#1' THEN CAST(0.012 AS DOUBLE) WHEN 'Brand#2' THEN CAST(0.272 AS DOUBLE)
          ELSE CAST(1.27 AS DOUBLE) END + 0.5) AS usd
          FROM products WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND price > 0)""")
def _(e):
    from modiste.plans.maintenance import fx_normalize

    return fx_normalize(e.products, FX).select("object_id", C("new_price").alias("usd"), C("new_range").alias("bucket"))


@query("fn_category_from_title", f"SELECT doc_id, {case_words('lower(text)', vocab.FEED_CATEGORY_WORDS)} AS category FROM documents")
def _(e):
    return e.table("documents").select("doc_id", text.category_from_title(C("text")).alias("category"))


FALLBACK = {"jacket": ["rod", "promo"], "dress": ["ring"], "shoes": ["small", "economy"]}


@query("fn_category_fallback", f"""SELECT object_id, coalesce({case_words('title', FALLBACK, 'NULL')}, {case_words('material', FALLBACK, 'NULL')},
    nullif({SLUG.format('vendor')}, ''), 'other') AS category
    FROM (SELECT *, CASE WHEN price < 200 THEN concat(' ', brand, ' / Line ') ELSE '' END AS vendor FROM products)""")
def _(e):
    vendor = F.when(C("price") < 200, F.concat(F.lit(" "), C("brand"), F.lit(" / Line "))).otherwise("")
    return e.products.select("object_id", text.category_fallback(C("title"), C("material"), vendor, FALLBACK).alias("category"))


CRUMBS = "CASE " + " ".join(f"WHEN regexp_matches(crumbs, {rx(kws)}) THEN '{cat}'" for cat, kws in vocab.BREADCRUMB_WORDS) + " END"


@query("fn_category_from_breadcrumb", f"""SELECT object_id, coalesce({CRUMBS}, {case_words('title', vocab.MARKETPLACE_CATEGORY_WORDS)}) AS category
    FROM (SELECT object_id, title, lower(concat('Women ', CASE WHEN price < 150 THEN category ELSE 'sale' END, ' ', color)) AS crumbs FROM products)""")
def _(e):
    crumbs = F.array(F.lit("Women"), F.when(C("price") < 150, C("category")).otherwise("sale"), C("color"))
    return e.products.select("object_id", text.category_from_breadcrumb(crumbs, C("title")).alias("category"))


def tag_list(col: str, aesthetics: dict) -> str:
    parts = [f"CASE WHEN regexp_matches({col}, {rx(kws)}) THEN '{tag}' END" for tag, kws in aesthetics.items()]
    parts += [f"CASE WHEN contains({col}, '{w}') THEN '{w}' END" for w in [*vocab.TAG_COLORS, *vocab.LENGTH_WORDS]]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '|')"


@query("fn_aesthetic_tags", f"""SELECT doc_id, {tag_list('low', vocab.FEED_AESTHETICS)} AS feed, {tag_list('low', vocab.MARKETPLACE_AESTHETICS)} AS marketplace
    FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def _(e):
    return e.table("documents").select("doc_id", F.array_join(text.aesthetic_tags(C("text")), "|").alias("feed"),
                                       F.array_join(text.aesthetic_tags(C("text"), vocab.MARKETPLACE_AESTHETICS), "|").alias("marketplace"))


@query("fn_is_mens", rf"""SELECT doc_id, regexp_matches(low, {rx(vocab.MENS_WORDS)}) AS by_substring,
    regexp_matches(low, '\b(?:{"|".join(vocab.MENS_WORDS)})\b') AS by_word, (lang = 'de' OR regexp_matches(low, {quoted(vocab.MENS_PHRASE)})) AS by_phrase
    FROM (SELECT doc_id, lang, lower(text) AS low FROM documents)""")
def _(e):
    t, gender = C("text"), F.when(C("lang") == "de", "male")
    return e.table("documents").select("doc_id", text.is_mens(t, mode="substring").alias("by_substring"), text.is_mens(t, mode="words").alias("by_word"),
                                       text.is_mens(F.lit(None).cast("string"), t, gender, head=None).alias("by_phrase"))


@query("fn_strip_html", """SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages)""")
def _(e):
    t = text.strip_html(C("html"), limit=None)
    return e.table("pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t.cast("binary")).alias("digest"))


def entities_sql() -> str:
    """Hex, decimal, named entities and backslash-u escapes in that order; the ampersand last, as the named ones are replaced in one pass."""
    def each(col, pattern, mark, char):
        return f"list_reduce(list_prepend({col}, list_distinct(regexp_extract_all({col}, '{pattern}', 1))), lambda x, m: replace(x, {mark}, {char}))"

    code, hexa = "chr(CAST(m AS INTEGER))", "chr(CAST(concat('0x', m) AS INTEGER))"
    named = "c"
    for name, char in sorted(vocab.NAMED_ENTITIES.items(), key=lambda x: x[0] == "amp"):
        named = f"replace({named}, '&{name};', chr({ord(char)}))"
    return f"""WITH a AS (SELECT page_id, concat(html, '&#8364;&#x41;&lt;&amp;lt;&bull;', chr(92), 'u00e9') AS a FROM pages), b AS (SELECT page_id, {each('a', '&#x([0-9a-fA-F]+);', "concat('&#x', m, ';')", hexa)} AS b FROM a),
        c AS (SELECT page_id, {each('b', '&#([0-9]+);', "concat('&#', m, ';')", code)} AS c FROM b), d AS (SELECT page_id, {named} AS d FROM c), t AS (SELECT page_id, {each('d', '[\\\\]u([0-9a-fA-F]{4})', "concat(chr(92), 'u', m)", hexa)} AS t FROM d)
        SELECT page_id, length(t) AS n, md5(t) AS digest FROM t"""


@query("fn_decode_entities", entities_sql())
def _(e):
    t = text.decode_entities(F.concat("html", F.lit("&#8364;&#x41;&lt;&amp;lt;&bull;\\u00e9")))
    return e.table("pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n"), F.md5(C("t").cast("binary")).alias("digest"))


@query("fn_clean_image_url", """SELECT object_id, CASE WHEN starts_with(u, 'http') AND contains(u, 'img.example.com') THEN split_part(u, '?', 1) ELSE u END AS url
    FROM (SELECT object_id, CASE WHEN price < 200 THEN image_url || '?v=' || object_id ELSE concat('https://other.example.org/', object_id, '?v=1') END AS u FROM products)""")
def _(e):
    u = F.when(C("price") < 200, F.concat("image_url", F.lit("?v="), "object_id")).otherwise(
        F.concat(F.lit("https://other.example.org/"), "object_id", F.lit("?v=1")))
    return e.products.select("object_id", text.clean_image_url(u, "img.example.com").alias("url"))


@query("fn_object_id", rf"""SELECT page_id, concat('shpfy-', d, '-', CAST(page_id AS VARCHAR)) AS shop_id,
    left(concat('html-', d, '-', {SLUG.format("u")}), 120) AS html_id
    FROM (SELECT page_id, url AS u, regexp_replace(split_part(url, '/', 3), '[^a-zA-Z0-9]', '', 'g') AS d FROM pages)""")
def _(e):
    host = F.split_part(C("url"), F.lit("/"), F.lit(3))
    return e.table("pages").select("page_id", text.object_id("shpfy", host, C("page_id")).alias("shop_id"),
                                   text.object_id("html", host, C("url"), slug=True).alias("html_id"))


NAMES = "CASE h " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in vocab.RETAILER_NAMES.items()) + " END"


@query("fn_retailer_name", rf"""SELECT object_id, coalesce({NAMES}, array_to_string(list_transform(string_split(replace(split_part(regexp_replace(h, '\.com.*$', ''), '.', 1), '-', ' '), ' '),
        lambda w: concat(upper(w[1]), w[2:])), ' ')) AS shop
    FROM (SELECT object_id, regexp_replace(CASE category WHEN 'dress' THEN 'www.asos.com' WHEN 'top' THEN 'us.zara.com' WHEN 'bottom' THEN 'net-a-porter.com'
          ELSE concat('www.uk.the-', lower(material), '-', retailer, '.com.au') END, '^(?:www\.|[a-z]{{2}}\.)+', '') AS h FROM products)""")
def _(e):
    domain = (F.when(C("category") == "dress", "www.asos.com").when(C("category") == "top", "us.zara.com").when(C("category") == "bottom", "net-a-porter.com")
              .otherwise(F.concat(F.lit("www.uk.the-"), F.lower("material"), F.lit("-"), "retailer", F.lit(".com.au"))))
    return e.products.select("object_id", text.retailer_name(domain).alias("shop"))


@query("fn_host_of", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages")
def _(e):
    return e.table("pages").select("page_id", text.host_of(C("url")).alias("host"))


@query("fn_brand_domain_candidates", r"""WITH s AS (SELECT object_id, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(split_part(concat(title, '-', material, ' & Studio (', brand, ')|x'), '|', 1), '\([^)]*\)', '', 'g')), '&', 'and'),
        '[.,''’!?®™"]', '', 'g'), '[^a-z0-9\s+-]', '', 'g')) AS s FROM products),
    b AS (SELECT object_id, regexp_replace(s, '\s+', '', 'g') AS c, regexp_replace(s, '\s+', '-', 'g') AS d FROM s),
    l AS (SELECT DISTINCT object_id, unnest([c, d, regexp_replace(c, '(the|studios?|collection|official|store|label)$', ''),
          regexp_replace(d, '(the|studios?|collection|official|store|label)$', ''), replace(c, '-', '')]) AS base FROM b)
    SELECT object_id, concat(base, t) AS domain FROM l, (VALUES """ + ", ".join(f"('{t}')" for t in vocab.PROBE_TLDS) + r""") x(t) WHERE length(base) >= 3""")
def _(e):
    name = F.concat("title", F.lit("-"), "material", F.lit(" & Studio ("), "brand", F.lit(")|x"))
    return e.products.select("object_id", F.explode(text.brand_domain_candidates(name)).alias("domain"))


@query("fn_display_text", "SELECT object_id, coalesce(nullif(trim(concat(color, ' ')), ''), title) AS shown FROM products")
def _(e):
    return e.products.select("object_id", text.display_text(F.concat("color", F.lit(" ")), C("title")).alias("shown"))


@query("fn_ascii_ratio", f"SELECT doc_id, {r6('length(regexp_replace(text, ' + quoted(chr(91) + '^' + chr(92) + 'x00-' + chr(92) + 'x7F]') + ', chr(0)[2:], ' + quoted('g') + ')) / length(text)')} AS ratio FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, 1.0 FROM documents WHERE length(text) = 0")
def _(e):
    return e.table("documents").select("doc_id", r6c(text.ascii_ratio(C("text"))).alias("ratio"))


@query("fn_looks_english", rf"""SELECT doc_id, CASE WHEN trim(t) = '' THEN true WHEN length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t) < 0.97 THEN false
        ELSE len(regexp_extract_all(lower(t), '\b(?:{"|".join(vocab.ENGLISH_WORDS)})\b')) >= 3
          OR (length(d) < 30 AND len(regexp_extract_all(lower(t), '\b(?:{"|".join(vocab.ENGLISH_WORDS)})\b')) >= 0.5 * nt AND nt >= 2) END AS english
    FROM (SELECT doc_id, concat(title, ' ', d) AS t, d, len(list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '')) AS nt
          FROM (SELECT doc_id, CASE WHEN length(text) < 200 THEN text ELSE '' END AS title, CASE WHEN length(text) < 200 THEN '' ELSE text END AS d FROM documents))""")
def _(e):
    short = F.length("text") < 200
    return e.table("documents").select("doc_id", text.looks_english(F.when(short, C("text")).otherwise(""), F.when(short, "").otherwise(C("text")),
                                                                    head=None).alias("english"))


TIERS = {"under100": ("price < 100", "budget"), "100to300": ("price >= 100 AND price < 300", "mid"),
         "300to1000": ("price >= 300 AND price < 1000", "luxury"), "over1000": ("price >= 1000", "luxury")}


@query("fn_price_tier_match", "SELECT object_id, " + ", ".join(
    f"CASE WHEN price IS NOT NULL THEN {c} ELSE b = '' OR b = '{w}' END AS t_{t}" for t, (c, w) in TIERS.items())
    + " FROM (SELECT object_id, price, CASE WHEN size > 25 THEN 'mid' ELSE '' END AS b FROM products)")
def _(e):
    b = F.when(C("size") > 25, "mid").otherwise("")
    return e.products.select("object_id", *[scores.price_tier_match(C("price"), b, t).alias(f"t_{t}") for t in TIERS])


@query("fn_dwell_score", f"SELECT event_id, {r6('CASE WHEN dwell_ms <= 500 THEN 0.0 WHEN dwell_ms >= 8000 THEN 1.0 ELSE ln(dwell_ms / 500) / ln(16.0) END')} AS score FROM signals")
def _(e):
    return e.signals.select("event_id", r6c(scores.dwell_score(C("dwell_ms"))).alias("score"))


@query("fn_dwell_bucket", "SELECT event_id, CASE WHEN dwell_ms > 7000 THEN 'strong_positive' WHEN dwell_ms > 2500 THEN 'positive' WHEN dwell_ms > 700 THEN 'neutral' ELSE 'negative' END AS bucket FROM signals")
def _(e):
    return e.signals.select("event_id", scores.dwell_bucket(C("dwell_ms")).alias("bucket"))


@query("fn_recency_weight", f"SELECT event_id, {r6(f'exp(-ln(2.0) * greatest(0.0, (epoch_us(TIMESTAMP {quoted(AS_OF)}) - epoch_us(ts)) / 86400e6) / 30)')} AS w FROM signals")
def _(e):
    return e.signals.select("event_id", r6c(scores.recency_weight(C("ts"), F.lit(AS_OF).cast("timestamp"))).alias("w"))


@query("fn_query_classify", f"""WITH t AS (SELECT query_id, string_split(text, ' ') AS w FROM query_log),
    b AS (SELECT DISTINCT lower(brand) AS brand FROM products),
    f AS (SELECT query_id, CAST(len(list_intersect(w, (SELECT list(brand) FROM b))) > 0 AS INTEGER) AS hb,
          CAST(len(list_intersect(w, [{in_list(vocab.GARMENTS)}])) > 0 AS INTEGER) AS hg,
          CAST(len(list_intersect(w, [{in_list(vocab.QUERY_COLORS)}])) > 0 AS INTEGER) AS hc FROM t)
    SELECT query_id, hb = 1 AS has_brand, hg = 1 AS has_garment, hc = 1 AS has_color, CASE WHEN hb + hg + hc >= 2 THEN 'literal' WHEN hb + hg + hc = 1 THEN 'mixed' ELSE 'abstract' END AS type FROM f""")
def _(e):
    return classify_queries(e.query_log, e.products.select("brand")).select("query_id", "has_brand", "has_garment", "has_color", "type")


def sorted_list(expr: str) -> str:
    return f"array_to_string(list_sort(list_distinct({expr})), '|')"


WORD_CATS = ", ".join(f"'{w}': '{c}'" for c, ws in vocab.STEER_CATEGORY_WORDS.items() for w in ws)
TAKEN = in_list([*vocab.STEER_ABSTRACT, *vocab.STEER_STOPWORDS, *vocab.STEER_COLORS, *[w for ws in vocab.STEER_CATEGORY_WORDS.values() for w in ws]])
PARSED = rf"""parsed0 AS (SELECT event_id, raw_text, lower(trim(raw_text)) AS t FROM steers),
  parsed1 AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(t, '[^a-z0-9\s\-]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM parsed0),
  parsed2 AS (SELECT *, list_filter(w, lambda x: list_contains([{in_list(vocab.STEER_COLORS)}], x)) AS colors,
    list_filter(list_transform(w, lambda x: CASE """ + " ".join(f"WHEN x IN ({in_list(ws)}) THEN '{c}'" for c, ws in vocab.STEER_CATEGORY_WORDS.items()) + rf""" END), lambda x: x IS NOT NULL) AS categories,
    list_filter(regexp_extract_all(t, {quoted(vocab.MORE_PHRASE)}, 1), lambda x: NOT list_contains([{TAKEN}], x)) AS search_terms,
    list_filter(flatten(list_transform(regexp_extract_all(t, {quoted(vocab.NEGATION_PHRASE)}, 1), lambda ph: flatten(list_transform(
        list_filter(regexp_split_to_array(trim(regexp_split_to_array(ph, {quoted(vocab.NEGATION_STOP)})[1]), '\s+'), lambda k: k <> ''),
        lambda k: [trim(regexp_replace(k, 's$', '')), k])))), lambda k: length(k) >= 3 AND NOT list_contains([{in_list(vocab.STEER_STOPWORDS)}], k)) AS avoid_terms,
    TRY_CAST(regexp_extract(t, {quoted(vocab.UNDER_DOLLAR)}, 1) AS INTEGER) AS u, TRY_CAST(regexp_extract(t, {quoted(vocab.OVER_DOLLAR)}, 1) AS INTEGER) AS o FROM parsed1),
  parsed3 AS (SELECT *, CASE WHEN u <= 150 THEN 'budget' WHEN u <= 500 THEN 'mid' WHEN u IS NOT NULL THEN 'luxury' WHEN o >= 500 THEN 'luxury' WHEN o IS NOT NULL THEN 'mid'
    WHEN regexp_matches(t, {quoted(vocab.BUDGET_PHRASE)}) THEN 'budget' WHEN regexp_matches(t, {quoted(vocab.LUXURY_PHRASE)}) THEN 'luxury'
    WHEN regexp_matches(t, {quoted(vocab.MID_PHRASE)}) THEN 'mid' END AS price_range FROM parsed2),
  parsed AS (SELECT *, len(colors) = 0 AND len(categories) = 0 AND len(avoid_terms) = 0 AND price_range IS NULL AS bare FROM parsed3)"""


@query("fn_steer_parse", rf"""WITH {PARSED} SELECT event_id, {sorted_list('colors')} AS colors, {sorted_list('categories')} AS categories, {sorted_list('search_terms')} AS search_terms,
    {sorted_list('avoid_terms')} AS avoid_terms, price_range, (NOT bare OR len(search_terms) > 0) AS is_concrete,
    (len(list_intersect(w, [{in_list(vocab.STEER_ABSTRACT)}])) > 0 OR (bare AND regexp_matches(t, {quoted(vocab.SHIFT_PHRASE)}))) AS is_abstract FROM parsed""")
def _(e):
    s = e.steers.select("event_id", steer.steer_parse(C("raw_text")).alias("s"))
    lists = [F.array_join(F.sort_array(C(f"s.{k}")), "|").alias(k) for k in ("colors", "categories", "search_terms", "avoid_terms")]
    return s.select("event_id", *lists, "s.price_range", "s.is_concrete", "s.is_abstract")


@query("fn_steer_merge", rf"""WITH {PARSED} SELECT event_id, {sorted_list("list_concat(colors, ['teal'])")} AS colors, {sorted_list("list_concat(categories, ['bag'])")} AS categories,
    {sorted_list("search_terms")} AS search_terms, coalesce(CASE WHEN p.price < 200 THEN 'luxury' END, parsed.price_range) AS price_range,
    CASE WHEN p.price < 100 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS edge, CAST(0.1 AS DOUBLE) AS drape, CASE WHEN p.tag <> '' THEN p.tag ELSE trim(raw_text) END AS intent
    FROM parsed JOIN steers USING (event_id, raw_text) JOIN products p USING (object_id)""")
def _(e):
    empty = F.array().cast("array<string>")
    j = e.steers.join(e.products.select("object_id", "price", "tag"), "object_id")
    fast = F.struct(steer.steer_parse(C("raw_text")).alias("p"))
    fast = F.struct(*[fast["p"][k].alias(k) for k in ("search_terms", "avoid_terms", "categories", "colors", "price_range", "intent")],
                    F.create_map(F.lit("edge"), F.lit(0.25), F.lit("drape"), F.lit(0.1)).alias("style_axes"))
    rich = F.struct(empty.alias("search_terms"), empty.alias("avoid_terms"), F.array(F.lit("bag")).alias("categories"), F.array(F.lit("teal")).alias("colors"),
                    F.when(C("price") < 200, "luxury").alias("price_range"), C("tag").alias("intent"),
                    F.map_from_arrays(F.when(C("price") < 100, F.array(F.lit("edge"))).otherwise(empty),
                                      F.when(C("price") < 100, F.array(F.lit(-0.5))).otherwise(F.array().cast("array<double>"))).alias("style_axes"))
    m = j.select("event_id", fast.alias("f"), rich.alias("r")).select("event_id", steer.steer_merge(C("f"), C("r")).alias("m"))
    lists = [F.array_join(F.sort_array(C(f"m.{k}")), "|").alias(k) for k in ("colors", "categories", "search_terms")]
    return m.select("event_id", *lists, "m.price_range", C("m.style_axes")["edge"].alias("edge"), C("m.style_axes")["drape"].alias("drape"), "m.intent")


@query("fn_steer_query", r"""SELECT object_id, array_to_string(list_filter(list_concat([tag, color, category], list_transform(list_filter(string_split(title, ' '), lambda w: length(w) >= 3), lambda w: concat('-', w))), lambda t: t <> ''), ' ') AS q FROM products""")
def _(e):
    return e.products.select("object_id", steer.steer_query(F.array("tag"), F.array("color"), F.array("category"),
                                                            F.array(F.concat(F.lit("-"), "title"))).alias("q"))


@query("fn_bias_query", "SELECT object_id, array_to_string(list_filter([brand, retailer, category, color], lambda t: t <> ''), ' ') AS q FROM products")
def _(e):
    return e.products.select("object_id", steer.bias_query(F.array("brand", "retailer"), F.array("category"), F.array("color")).alias("q"))


@query("fn_edit_seed_query", r"""SELECT object_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(concat(title, ' ', description, ', ', brand, '-x')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)[1:8], ' ') AS q FROM products""")
def _(e):
    sub = F.concat("description", F.lit(", "), "brand", F.lit("-x"))
    return e.products.select("object_id", text.edit_seed_query(C("title"), sub).alias("q"))


@query("fn_vibe_phrases", """SELECT object_id, CASE WHEN price < 100 THEN concat(title, '|', material) WHEN tag = '' AND color = '' AND size > 25 THEN ''
    ELSE concat('a photo of ', CASE WHEN tag <> '' THEN concat('a ', tag, ' outfit') ELSE 'an outfit' END,
      CASE WHEN color <> '' THEN concat(' in ', color, ', teal and sage') ELSE ' in teal and sage' END, CASE WHEN size <= 25 THEN concat(' with ', material) ELSE '' END) END AS phrases
    FROM (SELECT * FROM products WHERE NOT (tag = '' AND color = '' AND size > 25))""")
def _(e):
    empty = F.array().cast("array<string>")
    own = F.when(C("price") < 100, F.array("title", "material", F.lit(" "))).otherwise(empty)
    colors = F.filter(F.array("color", F.lit("teal"), F.lit("sage")), lambda x: x != "")
    sils = F.when(C("size") <= 25, F.array("material")).otherwise(empty)
    p = e.products.where(~((C("tag") == "") & (C("color") == "") & (C("size") > 25)))
    return p.select("object_id", F.array_join(text.vibe_phrases(own, C("tag"), colors, sils), "|").alias("phrases"))


@query("fn_prompt_template", """SELECT object_id, CASE WHEN price < 100 THEN concat('A  photo of ', title) ELSE concat('a photo of ', title) END AS prompt FROM products""")
def _(e):
    t = F.when(C("price") < 100, F.concat(F.lit(" A  photo of "), "title")).otherwise(F.concat(F.lit(" "), "title"))
    return e.products.select("object_id", text.prompt_template(t).alias("prompt"))


@query("fn_query_augment", """SELECT object_id, CASE WHEN tag = '' THEN '' ELSE concat(title, '|', material, ' skirt|', material, ' pants') ||
    CASE WHEN length(brand) > 2 THEN concat('|', lower(brand), ' skirt|', lower(brand), ' pants') ELSE '' END END AS q FROM products""")
def _(e):
    seed = F.when(C("tag") == "", F.array().cast("array<string>")).otherwise(F.array("title"))
    palette = F.array(F.concat(F.lit("Dusty "), "material"), F.lit("off 9x"), F.lit("an ox"), C("brand"))
    return e.products.select("object_id", F.array_join(text.query_augment(seed, palette, text.lit_array(["skirt", "pants"])), "|").alias("q"))


@query("fn_dna_hash", "SELECT object_id, substr(sha1(lower(concat(tag, '|', brand, '|', color, '|', title))), 1, 12) AS h FROM products")
def _(e):
    return e.products.select("object_id", text.dna_hash(C("tag"), C("brand"), C("color"), C("title")).alias("h"))


ENRICHED = """concat('{"attributes":{"silhouette":"', upper(title), '","pattern":"', color, '","aesthetic_tags":["A","', tag, '","C","D","E"]},"style_axes":{"formality":', CAST(pos % 3 - 1 AS VARCHAR(9)),
    ',"edge":"0.', CAST(pos % 10 AS VARCHAR(9)), '","drape":"high","romance":0.', CAST(size AS VARCHAR(9)), '},"caption":" ', description, ' "}')"""


@query("fn_normalize_enrichment", f"""SELECT object_id, lower(j ->> '$.attributes.silhouette') AS silhouette, 'other' AS fabric, lower(j ->> '$.attributes.pattern') AS pattern, 'casual' AS mood,
    concat('a|', tag, '|c|d') AS tags, CAST(greatest(0, least(1, CAST(j ->> '$.style_axes.formality' AS DOUBLE))) AS DOUBLE) AS formality, CAST(0.5 AS DOUBLE) AS minimalism, CAST(j ->> '$.style_axes.edge' AS DOUBLE) AS edge,
    CAST(j ->> '$.style_axes.romance' AS DOUBLE) AS romance, CAST(0.5 AS DOUBLE) AS drape, trim(j ->> '$.caption') AS caption FROM (SELECT object_id, tag, CAST({ENRICHED} AS JSON) AS j FROM products)""")
def _(e):
    p = e.products.select("object_id", F.expr(ENRICHED).alias("j"), "tag")
    n = p.select("object_id", scores.normalize_enrichment(C("j")).alias("n"))
    return n.select("object_id", "n.silhouette", "n.fabric", "n.pattern", "n.mood", F.array_join("n.aesthetic_tags", "|").alias("tags"),
                    *[f"n.{a}" for a in vocab.AXES], "n.caption")


@query("fn_sanitize_axis_deltas", """SELECT object_id, CASE WHEN price IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, price / 100 - 2)) END AS edge, CAST(1.0 AS DOUBLE) AS drape, CAST(CASE WHEN price IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n FROM products""")
def _(e):
    m = F.create_map(F.lit("edge"), C("price") / 100 - 2, F.lit("drape"), F.lit(7.0), F.lit("sparkle"), F.lit(0.5))
    d = e.products.select("object_id", scores.sanitize_axis_deltas(m).alias("d"))
    return d.select("object_id", C("d")["edge"].alias("edge"), C("d")["drape"].alias("drape"), F.size("d").cast("long").alias("n"))


@query("fn_migrate_label_keys", """SELECT object_id, CASE WHEN price < 100 THEN 'age-32-plus|age-18-24' WHEN price < 200 THEN 'age-25-32|age-32-plus' ELSE 'age-18-24|age-32-plus' END AS labels FROM products""")
def _(e):
    arr = (F.when(C("price") < 100, text.lit_array(["age-32-40", "age-18-24", "age-40-60"])).when(C("price") < 200, text.lit_array(["age-25-32", "age-40-60"]))
           .otherwise(text.lit_array(["age-18-24", "age-32-plus", "age-32-40"])))
    return e.products.select("object_id", F.array_join(text.migrate_label_keys(arr), "|").alias("labels"))
