"""Registered queries of the sources and sinks. Feed payloads are built from the catalogue rows, so their size follows the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from modiste.functions import scores
from modiste.sources import catalog, feeds, sinks
from modiste.workload.fixtures import query, quoted
from modiste import vocab
from modiste.workload.scalars import CRUMBS, SLUG, case_words

C = F.col
SHORT = ["object_id", "title", "brand", "retailer", "price", "price_range", "color", "image_url", "product_url", "category"]


def through_files(e, lines, name, reader):
    """One text column written as a feed's files below the shared folder and read by the feed's reader."""
    path = sinks.scratch_path(e.spark, name)
    lines.write.text(path)
    return reader(e.spark, path)


def short(df):
    return df.select(*SHORT)


def csv_text(e):
    """Raw cells of two vendor layouts, every value as text."""
    price = F.concat(F.lit("$"), C("price").cast("bigint").cast("string"), F.lit(".50"))
    url = F.when(C("size") == 7, "").otherwise(F.concat(F.lit("https://shop.example.com/"), "object_id"))
    a = e.products.select(F.when(C("size") > 25, C("object_id")).otherwise("").alias("sku_0"), F.lit("").alias("name_0"), C("title").alias("name_1"), price.alias("price_0"), F.lit("").alias("image_15"),
                          F.concat(F.coalesce("image_url", F.lit("no image")), F.lit("\nhttps://img.example.com/second.jpg")).alias("image_0"), F.concat(F.lit("COLOR: "), "color").alias("color_0"),
                          C("material").alias("product_material_0"), C("description").alias("description_0"), url.alias("data-page-selector"))
    b = e.products.select(F.lit(" ").alias("name"), C("title").alias("data"), C("brand").alias("brand"), F.lit("").alias("price"), price.alias("price2"), C("image_url").alias("image"), F.lit("x").alias("image2"),
                          C("description").alias("data4"), F.lit("").alias("data-page-selector"), url.alias("web_scraper_start_url"))
    return a, b


BUCKET = "CASE WHEN price IS NULL OR price = 0 THEN 'unknown' WHEN price < 50 THEN 'budget' WHEN price < {hi} THEN 'mid' ELSE 'luxury' END AS price_range"


@query("src_vendor_csv", f"""WITH p AS (SELECT *, CAST(CAST(price AS BIGINT) AS VARCHAR) AS whole, concat('https://shop.example.com/', object_id) AS url FROM products WHERE size <> 7),
    a AS (SELECT CASE WHEN size > 25 THEN object_id ELSE concat('asos-', left(md5(url), 16)) END AS object_id, title, title AS brand, 'One' AS retailer, CAST(whole || '.50' AS DOUBLE) AS price, color, coalesce(image_url, 'https://img.example.com/second.jpg') AS image_url, url AS product_url, pos FROM p),
    b AS (SELECT concat('revolve2-', left(md5(url), 16)) AS object_id, title, brand, 'Two' AS retailer, CAST(whole || '.50' AS DOUBLE) AS price, '' AS color, coalesce(image_url, '') AS image_url, url AS product_url, pos FROM p),
    u AS (SELECT *, row_number() OVER (PARTITION BY retailer, title ORDER BY object_id) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT object_id, title, brand, retailer, price, {BUCKET.format(hi=150)}, color, image_url, product_url, 'other' AS category FROM u WHERE rn = 1""")
def _(e):
    a, b = csv_text(e)
    return short(feeds.vendor_feeds([(a, "asos", "One"), (b, "revolve2", "Two")]))


def market_raw(e):
    """Marketplace products as JSON text, parsed with the feed's schema."""
    offers = F.array(F.struct(F.concat(F.lit("https://a.example.com/"), "object_id").alias("url"), F.lit("www.asos.com").alias("domain"), F.lit("OutOfStock").alias("availability"), F.struct(F.lit(999.0).alias("price")).alias("price")),
                     F.struct(F.concat(F.lit("https://b.example.com/"), "object_id").alias("url"), F.lit("us.the-shop.com").alias("domain"), F.when(C("size") > 10, "InStock").otherwise("OutOfStock").alias("availability"),
                              F.struct(C("price").alias("price")).alias("price")))
    images = F.array(F.struct(F.lit("https://img.example.com/first.jpg").alias("url"), F.lit(False).alias("is_main_image")), F.struct(C("image_url").alias("url"), (C("image_url").isNotNull()).alias("is_main_image")))
    row = F.struct(C("object_id").alias("id"), F.when(C("size") == 9, F.concat("title", F.lit(" for boys"))).otherwise(C("title")).alias("title"), "description", F.when(C("size") == 8, "male").alias("gender"),
                   F.array(F.struct(C("brand").alias("name"))).alias("brands"), F.array("material").alias("materials"), F.array(F.lit("Women"), C("category")).alias("categories"), images.alias("images"), offers.alias("offers"))
    text = e.products.select("pos", F.to_json(row).alias("j"))
    return text.select("pos", F.from_json("j", feeds.MARKETPLACE_SCHEMA).alias("r")).select("pos", "r.*")


@query("src_marketplace_json", f"""SELECT object_id, CASE WHEN size = 9 THEN concat(title, ' for boys') ELSE title END AS title, brand, CASE WHEN size > 10 THEN 'The Shop' ELSE 'ASOS' END AS retailer, price, {BUCKET.format(hi=200)}, '' AS color,
    image_url, concat('https://', CASE WHEN size > 10 THEN 'b' ELSE 'a' END, '.example.com/', object_id) AS product_url, coalesce({CRUMBS}, {case_words('title', vocab.MARKETPLACE_CATEGORY_WORDS)}) AS category
    FROM (SELECT object_id, size, title, brand, concat('women ', category) AS crumbs, CASE WHEN size > 10 THEN price ELSE 999.0 END AS price, coalesce(image_url, 'https://img.example.com/first.jpg') AS image_url FROM products)""")
def _(e):
    raw = market_raw(e).drop("pos")
    return short(feeds.marketplace_json(through_files(e, raw.select(F.to_json(F.struct(*raw.columns))), "marketplace", feeds.read_marketplace_json)))


@query("src_marketplace_dedup_filter", "SELECT key AS id, title FROM (SELECT title AS key, title, row_number() OVER (PARTITION BY title ORDER BY pos) AS rn FROM products WHERE size NOT IN (8, 9)) WHERE rn = 1")
def _(e):
    raw = market_raw(e).withColumn("id", F.regexp_replace("title", " for boys$", ""))
    return feeds.marketplace_dedup_filter(raw, ["pos"]).select("id", "title")


@query("src_storefront_json", f"""SELECT concat('shpfy-shopexamplecom-', CAST(pos AS VARCHAR)) AS object_id, title, 'House' AS brand, 'House' AS retailer, price, {BUCKET.format(hi=150)}, color, image_url, concat('https://shop.example.com/products/', replace(title, ' ', '-')) AS product_url, 'other' AS category
    FROM (SELECT pos, title, size, color, image_url, CAST(CAST(CAST(price AS BIGINT) AS VARCHAR) || '.25' AS DOUBLE) AS price FROM products) WHERE image_url IS NOT NULL AND size <> 6""")
def _(e):
    row = F.struct(C("pos").alias("id"), "title", F.when(C("size") == 6, "").otherwise(F.replace("title", F.lit(" "), F.lit("-"))).alias("handle"), F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("body_html"),
                   F.array("material").alias("tags"), F.array(F.struct(F.coalesce("image_url", F.lit("none")).alias("src"))).alias("images"),
                   F.array(F.struct(F.concat(C("price").cast("bigint").cast("string"), F.lit(".25")).alias("price"))).alias("variants"),
                   F.array(F.struct(F.lit("Size").alias("name"), F.array(F.lit("S")).alias("values")), F.struct(F.lit("COLOUR").alias("name"), F.array("color").alias("values"))).alias("options"))
    # one page of JSON per brand, as the paged endpoint delivers them
    pages = through_files(e, e.products.select(F.to_json(F.struct(F.array(row).alias("products")))), "storefront", feeds.read_storefront_json)
    return short(feeds.storefront_json(pages, F.lit("shop.example.com"), F.lit("House")))


@query("src_woo_json", rf"""SELECT concat('woo-wooexamplecom-', CAST(pos AS VARCHAR)) AS object_id, concat(title, ' & co') AS title, 'Woo' AS brand, 'Woo' AS retailer, price, {BUCKET.format(hi=150)}, '' AS color, image_url, concat('https://woo.example.com/shop/', object_id, '/') AS product_url, {SLUG.format('brand')} AS category
    FROM (SELECT pos, object_id, title, brand, image_url, (price * 100 + 50) / 100 AS price FROM products) WHERE image_url IS NOT NULL""")
def _(e):
    row = F.struct(C("pos").alias("id"), F.concat("title", F.lit(" &amp; co")).alias("name"), C("object_id").alias("slug"), F.concat(F.lit("<b>"), "description", F.lit("</b>")).alias("short_description"),
                   F.struct((C("price") * 100 + 50).cast("bigint").cast("string").alias("price"), F.lit(2).alias("currency_minor_unit")).alias("prices"), F.array(F.struct(C("image_url").alias("src"))).alias("images"),
                   F.array(F.struct(C("brand").alias("name"))).alias("categories"))
    raw = through_files(e, e.products.select(F.to_json(row)), "woo", feeds.read_woo_json)
    return short(feeds.woo_json(raw, F.lit("woo.example.com"), F.lit("Woo")))


def html_pages(e):
    """The stored pages with a product block put into their head: an object, an array, a graph or Open Graph tags, by row."""
    p = e.table("pages").join(e.products, C("page_id") == C("pos"))
    obj = F.to_json(F.struct(F.lit("Product").alias("@type"), C("title").alias("name"), C("object_id").alias("sku"), F.array("image_url").alias("image"), C("color").alias("color"),
                             F.array(F.struct(C("price").cast("string").alias("price"))).alias("offers"), C("brand").alias("category")))
    block = F.when(C("size") < 15, obj).when(C("size") < 25, F.concat(F.lit('[{"@type":"Thing"},'), obj, F.lit("]"))).when(C("size") < 35, F.concat(F.lit('{"@graph":['), obj, F.lit("]}")))
    script = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    meta = F.concat(F.lit('<meta property="og:title" content="'), "title", F.lit('"><meta property="og:image" content="'), F.coalesce("image_url", F.lit("")), F.lit('">'))
    return p.select("url", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), F.when(C("size") < 35, script).otherwise(meta))).alias("html"))


@query("src_html_product", rf"""SELECT concat('html-', d, '-', {SLUG.format("CASE WHEN size < 35 THEN object_id ELSE title END")}) AS object_id, title, h AS brand, h AS retailer, price, {BUCKET.format(hi=150)}, color, image_url, url AS product_url, category
    FROM (SELECT url, regexp_replace(h0, '^www\.', '') AS h, regexp_replace(regexp_replace(h0, '^www\.', ''), '[^a-zA-Z0-9]', '', 'g') AS d, object_id, size, title, image_url, CASE WHEN size < 35 THEN price END AS price, CASE WHEN size < 35 THEN color ELSE '' END AS color, CASE WHEN size < 35 THEN {SLUG.format('brand')} ELSE 'other' END AS category
          FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h0 FROM pages JOIN products ON page_id = pos) WHERE image_url IS NOT NULL)""")
def _(e):
    return short(feeds.html_product(through_files(e, html_pages(e).select(F.to_json(F.struct("url", "html"))), "html", feeds.read_html_pages)))


@query("src_sitemap_urls", r"""SELECT 'page' AS kind, u AS url FROM (SELECT concat(split_part(url, '?', 1), CASE WHEN page_id % 2 = 0 THEN '/products/' ELSE '/blogs/products/' END, CAST(page_id AS VARCHAR), '?a=1&b=2') AS u FROM pages)
    WHERE NOT regexp_matches(u, '(?i)/(collections|category|categories|pages|blogs?|about|contact|search|account|cart|policies)/') AND regexp_matches(u, '(?i)/(product|products|shop|style|item)/')
    UNION ALL SELECT 'sitemap', concat(split_part(url, '?', 1), '/sub.xml') FROM pages""")
def _(e):
    base = F.split_part("url", F.lit("?"), F.lit(1))
    page = F.concat(base, F.when(C("page_id") % 2 == 0, "/products/").otherwise("/blogs/products/"), C("page_id").cast("string"), F.lit("?a=1&amp;b=2"))
    xml = F.concat(F.lit("<urlset><sitemap>\n <loc>"), base, F.lit("/sub.xml</loc></sitemap><url><priority>1</priority>\n<loc>"), page, F.lit("</loc></url></urlset>"))
    return feeds.sitemap_urls(through_files(e, e.table("pages").select(xml), "sitemaps", feeds.read_sitemaps))


@query("src_offer_color_explode", """WITH p AS (SELECT object_id, title, pos, unnest(CASE WHEN color = '' THEN [''] WHEN color = 'red' THEN ['Red', 'Milk Choc'] ELSE ['Milk Choc'] END) AS c FROM products)
    SELECT CASE WHEN c = '' THEN object_id ELSE concat(object_id, '-', replace(lower(c), ' ', '-')) END AS object_id, CASE WHEN c = '' OR contains(title, lower(c)) THEN title ELSE concat(title, ' — ', c) END AS title, c AS color,
    CASE WHEN c = '' THEN 'https://x.example.com/p' ELSE concat('https://x.example.com/p?Color=', replace(c, ' ', '%20')) END AS product_url FROM p""")
def _(e):
    u = F.lit("https://x.example.com/p?v=1")
    urls = F.when(C("color") == "", F.array(u)).when(C("color") == "red", F.array(u, F.lit("https://x.example.com/p?Color=Red"), F.lit("https://x.example.com/p?a=1&color=Milk+Choc#z"), F.lit("https://x.example.com/p?Color=RED"))).otherwise(
        F.array(F.lit("https://x.example.com/p?Color=Milk%20Choc")))
    p = e.products.select("object_id", "title", F.lit("").alias("color"), F.lit("https://x.example.com/p").alias("product_url"), urls.alias("offer_urls"))
    return feeds.offer_color_explode(p).select("object_id", "title", "color", "product_url")


def log_lines(e):
    """The signal log as curation JSON lines; fast dislikes are broken lines."""
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), C("session_id").alias("dna_hash"), F.when(C("kind") == "save", C("kind")).alias("primary"), F.array("object_id").alias("candidate_ids"),
                   F.when(C("kind") != "impression", F.array("object_id")).alias("kept_ids"))
    return e.signals.select(F.when((C("kind") == "dislike") & (C("dwell_ms") < 5000), F.lit('{"ts": broken')).otherwise(F.to_json(row)).alias("value"))


@query("src_curation_jsonl", """SELECT epoch(date_trunc('second', ts))::BIGINT AS at_s, session_id AS dna_hash, CASE WHEN kind = 'save' THEN 'save' ELSE '' END AS primary_aesthetic, 'mid' AS price_range, object_id AS candidates, CASE WHEN kind = 'impression' THEN '' ELSE object_id END AS kept, '' AS rejected
    FROM signals WHERE NOT (kind = 'dislike' AND dwell_ms < 5000)""")
def _(e):
    out = feeds.curation_lines(log_lines(e))
    lists = {"candidates": "candidate_ids", "kept": "kept_ids", "rejected": "rejected_ids"}
    return out.select(F.unix_seconds("created_at").alias("at_s"), "dna_hash", "primary_aesthetic", "price_range", *[F.array_join(v, "|").alias(k) for k, v in lists.items()])


@query("src_source_fallback", "SELECT event_id FROM signals WHERE kind = 'save' UNION ALL SELECT event_id FROM signals WHERE kind = 'click'")
def _(e):
    saves, clicks, none = (e.signals.where(C("kind") == k).select("event_id") for k in ("save", "click", "no such kind"))
    return feeds.source_fallback(saves, clicks).unionByName(feeds.source_fallback(none, clicks))


@query("src_browse_filtered", "SELECT object_id, brand, price FROM products WHERE category IN ('dress', 'top') AND price <= 200")
def _(e):
    return feeds.browse(e.products, C("category").isin("dress", "top") & (C("price") <= 200), ["object_id", "brand", "price"])


@query("sink_catalog_upsert", """SELECT object_id, title, price, brand FROM (
      SELECT p.object_id, p.title, CASE WHEN p.category = 'dress' THEN coalesce(p.price, 0) + 1 ELSE p.price END AS price, p.brand FROM products p WHERE p.category <> 'bag'
      UNION ALL SELECT concat('new-', object_id), upper(title), coalesce(price, 0) + 1, brand FROM products WHERE category = 'dress')""")
def _(e):
    cols = ["object_id", "title", "price", "brand"]
    path = sinks.scratch_path(e.spark, "catalog")
    catalog.create(e.products.select(*cols), path)
    dresses = e.products.where("category = 'dress'").withColumn("price", F.coalesce("price", F.lit(0.0)) + 1).withColumn("title", F.upper("title")).select(*cols)
    new = dresses.unionByName(dresses.withColumn("object_id", F.concat(F.lit("new-"), "object_id")))
    gone = e.products.where("category = 'bag'").select("object_id")
    return catalog.read(e.spark, path, catalog.upsert(e.spark, path, new, ["price"], gone))


@query("sink_vectors", """SELECT 'visual' AS namespace, object_id, round(vec[1], 6) AS v0 FROM vectors UNION ALL SELECT 'vibe', object_id, round(vec[1] * CASE WHEN ends_with(object_id, '3') THEN 2 ELSE 1 END, 6) FROM vibes
    UNION ALL SELECT 'vibe', concat('new-', object_id), round(vec[1] * 2, 6) FROM vibes WHERE ends_with(object_id, '3')""")
def _(e):
    path = sinks.scratch_path(e.spark, "vectors")
    both = e.vectors.select("object_id", F.lit("visual").alias("namespace"), "vec").unionByName(e.vibes.select("object_id", F.lit("vibe").alias("namespace"), "vec"))
    sinks.upsert_vectors(both, path)
    some = e.vibes.where(C("object_id").endswith("3")).select("object_id", F.lit("vibe").alias("namespace"), F.transform("vec", lambda x: x * 2).alias("vec"))
    sinks.upsert_vectors(some.unionByName(some.withColumn("object_id", F.concat(F.lit("new-"), "object_id"))), path)
    return e.spark.read.parquet(path).select("namespace", "object_id", F.round(F.get("vec", F.lit(0)), 6).alias("v0"))


@query("sink_jsonl_append", "SELECT event_id, user_token, object_id FROM signals WHERE kind IN ('save', 'click')")
def _(e):
    from modiste.workload.streams import signal_stream

    path = sinks.scratch_path(e.spark, "log")
    entries = signal_stream(e)[0].where(C("kind").isin("save", "click")).select("event_id", "user_token", "object_id")
    sinks.stream_jsonl(entries, path, sinks.scratch_path(e.spark, "stream-checkpoint"))
    return e.spark.read.schema("event_id long, user_token string, object_id string").json(path)
