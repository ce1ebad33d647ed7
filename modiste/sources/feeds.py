"""Vendor feeds to the one product schema. Readers take a path or a DataFrame; all parsing is column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import scores, text
from modiste.scale import first_per_key

C = F.col
PRODUCT_COLUMNS = ["object_id", "title", "brand", "retailer", "price", "price_range", "color", "material", "description", "image_url", "images", "product_url",
                   "aesthetic_tags", "category"]

# fixed values: for each vendor layout the cells tried in order, the default brand and the cell prefixes to strip
VENDOR_LAYOUTS = {
    "asos": {"id": ["sku_0"], "title": ["name_0", "name_1"], "brand": ["name_1"], "default_brand": "ASOS", "price": ["price_0"], "image": ["image_15", "image_14", "image_0"],
             "color": ["color_0"], "color_prefix": "COLOR:", "material": ["product_material_0"], "description": ["description_0"], "url": ["data-page-selector"]},
    "bloomingdales": {"title": ["product_name_0", "name_0"], "brand": ["brand_0", "name_1"], "default_brand": "Bloomingdale's", "price": ["price_1", "price_0"],
                      "image": ["image_0", "image_1"], "color": ["color_0"], "color_prefix": "Color:", "material": ["materials_care_0"], "description": ["features_0"],
                      "url": ["data-page-selector"]},
    "edikted": {"title": ["data_0"], "default_brand": "Edikted", "price": ["price_0"], "image": ["image_0"], "color": ["options_values_0"], "description": ["description_0"],
                "url": ["data-page-selector"]},
    "hellomolly": {"title": ["data_1", "name_1"], "default_brand": "Hello Molly", "price": ["data_0"], "image": ["image_0"],
                   "description": ["product_description_0", "description_0"], "url": ["data-page-selector"]},
    "nordstrom": {"title": ["name_6", "name_0"], "brand": ["name_0", "stores_amenities_name_9"], "default_brand": "Nordstrom", "price": ["price_0", "text_9"], "image": ["image_0"],
                  "color": ["Color_0"], "description": ["description_0"], "url": ["data-page-selector"]},
    "revolve1": {"title": ["data_0", "name_0"], "brand": ["name_1"], "default_brand": "Revolve", "price": ["price_0"], "image": ["image_0"], "color": ["color_0"],
                 "material": ["description_1"], "material_limit": 200, "description": ["description_0", "about_the_brand_0"], "url": ["data-page-selector"]},
    "revolve2": {"title": ["name", "data"], "brand": ["brand"], "default_brand": "Revolve", "price": ["price", "price2", "price3"],
                 "image_all": ["image", "image2", "image3", "image4", "image5", "image6", "image7", "image8", "image9", "image10"],
                 "description": ["data2", "data4"], "url": ["data-page-selector", "web_scraper_start_url"]},
}


def finish(df: DataFrame, tag_text: Column | None = None, category: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Add bucket, tags and category to a raw product row and fix the column order."""
    body = tag_text if tag_text is not None else F.concat_ws(" ", "title", "description", "color", "material")
    out = df.withColumn("price_range", bucket if bucket is not None else scores.price_bucket(C("price"))).withColumn("aesthetic_tags", text.aesthetic_tags(body))
    out = out.withColumn("category", category if category is not None else text.category_from_title(C("title")))
    return out.select(*PRODUCT_COLUMNS)


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, multi-line CSV with every column as text; a byte-order mark on the first header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def vendor_csv(raw: DataFrame, layout: str, retailer: str, limit: int = 500) -> DataFrame:
    """One vendor layout to products: the first non-empty cell of each list wins, rows without title or URL are dropped.

    Rows without a vendor id get `layout-` plus a digest of their URL, which stays the same when a feed is read again."""
    spec = VENDOR_LAYOUTS[layout]

    def pick(name: str, default: str = "") -> Column:
        cells = [text.filled(F.trim(C(f"`{c}`"))) for c in spec.get(name, []) if c in raw.columns]
        return F.coalesce(*cells, F.lit(default)) if cells else F.lit(default)

    if "image_all" in spec:
        image_text = F.concat_ws("\n", *[text.filled(C(f"`{c}`")) for c in spec["image_all"] if c in raw.columns])
    else:
        image_text = pick("image")
    images = F.slice(F.filter(F.transform(F.split(image_text, "\n"), lambda u: F.trim(u)), lambda u: u.startswith("http")), 1, 5)
    url = pick("url")
    own_id = text.filled(pick("id"))
    color = F.trim(F.replace(pick("color"), F.lit(spec["color_prefix"]), F.lit(""))) if "color_prefix" in spec else pick("color")
    material = F.substring(pick("material"), 1, spec["material_limit"]) if "material_limit" in spec else pick("material")
    rows = raw.select(F.coalesce(own_id, F.concat(F.lit(layout + "-"), F.substring(F.md5(url.cast("binary")), 1, 16))).alias("object_id"), pick("title").alias("title"),
                      pick("brand", spec["default_brand"]).alias("brand"), F.lit(retailer).alias("retailer"), scores.parse_price(pick("price")).alias("price"), color.alias("color"),
                      material.alias("material"), F.substring(pick("description"), 1, limit).alias("description"), F.coalesce(F.get(images, F.lit(0)), F.lit("")).alias("image_url"),
                      images.alias("images"), url.alias("product_url"))
    return finish(rows.where("title <> '' AND product_url <> ''"))


def vendor_feeds(feeds: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """All layouts united, one row per retailer and title (the smallest id wins)."""
    all_rows = reduce(DataFrame.unionByName, [vendor_csv(df, layout, retailer) for df, layout, retailer in feeds])
    return first_per_key(all_rows, ["retailer", "title"], ["object_id"])


MARKETPLACE_SCHEMA = (
    "id STRING, title STRING, description STRING, gender STRING, condition STRING, brands ARRAY<STRUCT<name: STRING>>, materials ARRAY<STRING>, categories ARRAY<STRING>, "
    "images ARRAY<STRUCT<url: STRING, is_main_image: BOOLEAN>>, offers ARRAY<STRUCT<url: STRING, domain: STRING, availability: STRING, price: STRUCT<price: DOUBLE>>>"
)


def read_marketplace_json(spark: SparkSession, path: str) -> DataFrame:
    """Marketplace products of JSON-lines files, for `marketplace_json`."""
    return spark.read.schema(MARKETPLACE_SCHEMA).json(path)


def read_storefront_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a storefront's product endpoint, a page a line, for `storefront_json`."""
    return spark.read.schema(STOREFRONT_SCHEMA).json(path)


def read_woo_json(spark: SparkSession, path: str) -> DataFrame:
    """Store-API products, a product a line or a page's array of them a line, for `woo_json`."""
    return spark.read.schema(WOO_SCHEMA).json(path)


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages as JSON lines with `url` and `html`, for `html_product`."""
    return spark.read.schema("url STRING, html STRING").json(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap texts, one per file of any number of lines, for `sitemap_urls`."""
    return spark.read.text(path, wholetext=True).select(C("value").alias("xml"))


def main_image(images: Column) -> Column:
    return F.coalesce(F.get(F.filter(images, lambda i: i["is_main_image"]), F.lit(0))["url"], F.get(images, F.lit(0))["url"])


def marketplace_json(raw: DataFrame) -> DataFrame:
    """Nested marketplace products (MARKETPLACE_SCHEMA) to rows: first in-stock offer else first, main image else first."""
    offer = F.coalesce(F.get(F.filter("offers", lambda o: o["availability"] == "InStock"), F.lit(0)), F.get("offers", F.lit(0)))
    empty = F.array().cast("array<string>")
    rows = raw.withColumn("__offer", offer).select(
        C("id").alias("object_id"), F.substring(F.coalesce("title", F.lit("")), 1, 150).alias("title"),
        F.substring(F.coalesce(F.get("brands", F.lit(0))["name"], F.lit("")), 1, 80).alias("brand"), text.retailer_name(C("__offer.domain")).alias("retailer"),
        C("__offer.price.price").alias("price"), F.lit("").alias("color"), F.substring(F.coalesce(F.get("materials", F.lit(0)), F.lit("")), 1, 80).alias("material"),
        F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"), F.coalesce(main_image(C("images")), F.lit("")).alias("image_url"), empty.alias("images"),
        F.coalesce("__offer.url", F.lit("")).alias("product_url"), F.coalesce("categories", empty).alias("__crumbs"),
        F.concat_ws(" ", "title", F.substring(F.coalesce("description", F.lit("")), 1, 150)).alias("__text"))
    category = text.category_from_breadcrumb(C("__crumbs"), C("title"))
    rows = rows.withColumn("price_range", scores.price_bucket(C("price"), luxury=200)).withColumn(
        "aesthetic_tags", text.aesthetic_tags(C("__text"), vocab.MARKETPLACE_AESTHETICS, [*vocab.TAG_COLORS, "stripe"])).withColumn("category", category)
    return rows.select(*PRODUCT_COLUMNS)


def marketplace_dedup_filter(raw: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """First acceptable row per id: with an image, not male, no menswear word in the title."""
    ok = ((F.coalesce(main_image(C("images")), F.lit("")) != "") & (F.coalesce("gender", F.lit("")) != "male")
          & ~F.lower(F.coalesce("title", F.lit(""))).rlike(vocab.MARKETPLACE_MENS_PHRASE) & (F.coalesce("id", F.lit("")) != ""))
    return first_per_key(raw.where(ok), ["id"], order)


STOREFRONT_SCHEMA = (
    "products ARRAY<STRUCT<id: BIGINT, title: STRING, handle: STRING, body_html: STRING, product_type: STRING, price: STRING, tags: ARRAY<STRING>, images: ARRAY<STRUCT<src: STRING>>, "
    "variants: ARRAY<STRUCT<price: STRING>>, options: ARRAY<STRUCT<name: STRING, values: ARRAY<STRING>>>>>"
)


def storefront_json(pages: DataFrame, domain: Column, brand: Column, keep_mens: bool = False, product_path: str = "/products/") -> DataFrame:
    """Paged product JSON (STOREFRONT_SCHEMA) to rows: first image and variant price, colour option; id = prefix+domain+id."""
    p = pages.select(domain.alias("__domain"), brand.alias("__brand"), F.explode("products").alias("p"))
    images = F.filter(F.transform(C("p.images"), lambda i: F.coalesce(i["src"], F.lit(""))), lambda s: s.startswith("http") & (F.length(s) > 20))
    option = F.get(F.filter(C("p.options"), lambda o: F.lower(o["name"]).isin("color", "colour")), F.lit(0))
    rows = p.select(text.object_id("shpfy", C("__domain"), C("p.id")).alias("object_id"), F.coalesce("p.title", F.lit("")).alias("title"), C("__brand").alias("brand"),
                    C("__brand").alias("retailer"), scores.parse_price(F.coalesce(F.get(C("p.variants"), F.lit(0))["price"], C("p.price"))).alias("price"),
                    F.coalesce(F.get(option["values"], F.lit(0)), F.lit("")).alias("color"), F.lit("").alias("material"), text.strip_html(C("p.body_html")).alias("description"),
                    F.get(images, F.lit(0)).alias("image_url"), F.slice(images, 1, 5).alias("images"), C("p.handle").alias("handle"),
                    F.concat(F.lit("https://"), "__domain", F.lit(product_path), "p.handle").alias("product_url"), C("p.tags").alias("__tags"), C("p.product_type").alias("__type"))
    rows = rows.where("image_url IS NOT NULL AND coalesce(handle, '') <> ''")
    if not keep_mens:
        rows = rows.where(~text.is_mens(C("title"), tags=C("__tags"), product_type=C("__type"), mode="words"))
    return finish(rows, F.concat_ws(" ", "title", "description", "color", F.array_join(F.coalesce("__tags", F.array().cast("array<string>")), " ")))


WOO_SCHEMA = (
    "id BIGINT, name STRING, slug STRING, permalink STRING, short_description STRING, description STRING, prices STRUCT<price: STRING, regular_price: STRING, currency_minor_unit: INT>, "
    "images ARRAY<STRUCT<src: STRING, thumbnail: STRING>>, tags ARRAY<STRUCT<name: STRING>>, categories ARRAY<STRUCT<name: STRING>>"
)


def woo_json(raw: DataFrame, domain: Column, brand: Column) -> DataFrame:
    """Store-API products (WOO_SCHEMA): prices in minor units, entities decoded, category from the title else the store's own."""
    images = F.filter(F.transform("images", lambda i: F.coalesce(text.filled(i["src"]), i["thumbnail"], F.lit(""))), lambda s: s.startswith("http"))
    price = scores.parse_price(F.coalesce(C("prices.price"), C("prices.regular_price"))) / F.pow(F.lit(10.0), F.coalesce(C("prices.currency_minor_unit"), F.lit(0)))
    body = F.coalesce(text.filled(C("short_description")), C("description"), F.lit(""))
    empty = F.array().cast("array<string>")
    rows = raw.select(text.object_id("woo", domain, C("id")).alias("object_id"), text.decode_entities(F.coalesce("name", F.lit(""))).alias("title"), brand.alias("brand"),
                      brand.alias("retailer"), price.alias("price"), F.lit("").alias("color"), F.lit("").alias("material"), text.decode_entities(text.strip_html(body)).alias("description"),
                      F.get(images, F.lit(0)).alias("image_url"), F.slice(images, 1, 5).alias("images"),
                      F.coalesce(text.filled(C("permalink")), F.concat(F.lit("https://"), domain, F.lit("/shop/"), "slug", F.lit("/"))).alias("product_url"),
                      F.coalesce(F.transform("tags", lambda t: t["name"]), empty).alias("__tags"), F.coalesce(F.transform("categories", lambda t: t["name"]), empty).alias("__cats"))
    rows = rows.where("title <> '' AND image_url IS NOT NULL").withColumn(
        "__text", F.concat_ws(" ", "title", "description", F.array_join("__tags", " "), F.array_join("__cats", " ")))
    rows = rows.where(~text.is_mens(C("__text"), mode="words"))
    category = F.coalesce(text.category_from_title(C("title"), None, None), text.filled(text.slugify(F.get("__cats", F.lit(0)))), F.lit("other"))
    return finish(rows, C("__text"), category)


LD_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _meta(html: Column, prop: str) -> Column:
    return text.filled(F.regexp_extract(html, rf"(?i)<meta[^>]+property=[\"']{prop}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1))


def _unescape(c: Column) -> Column:
    return text.decode_entities(c)


def ld_products(html: Column) -> Column:
    """JSON texts of the Product objects in the page's JSON-LD blocks: single objects, arrays and @graph."""
    def members(block):
        b = F.trim(block)
        graph = F.get_json_object(b, "$['@graph']")
        listed = F.when(b.startswith("["), b).when(graph.isNotNull(), graph).otherwise(F.concat(F.lit("["), b, F.lit("]")))
        return F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))

    def is_product(obj):
        kind = F.get_json_object(obj, "$['@type']")
        return (kind == "Product") | (kind.startswith("[") & kind.contains('"Product"'))

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(html, F.lit(LD_SCRIPT), 1), members)), is_product)


def html_product(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Product pages: JSON-LD first, Open Graph meta as fallback. Pages without title or http image are dropped."""
    p = pages.select(C(url).alias("product_url"), F.explode_outer(ld_products(C(html))).alias("ld"), *[_meta(C(html), m).alias(n) for n, m in (
        ("og_title", "og:title"), ("og_image", "og:image"), ("og_text", "og:description"), ("og_price", "product:price:amount"), ("og_price2", "og:price:amount"))])

    def ld(path):
        return F.get_json_object(C("ld"), path)

    img = ld("$.image")
    first_image = F.when(img.startswith("["), F.get(F.from_json(img, "array<string>"), F.lit(0))).when(img.startswith("{"), F.get_json_object(img, "$.url")).otherwise(img)
    offer = ld("$.offers")
    offer = F.when(offer.startswith("["), F.get(F.from_json(offer, "array<string>"), F.lit(0))).otherwise(offer)
    price = F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.lowPrice"), C("og_price"), C("og_price2"))
    host = text.host_of(C("product_url"))
    plain = lambda c: F.when(~c.rlike(r"^[\[{]"), c)  # noqa: E731 - objects and arrays are no text
    rows = p.select("product_url", host.alias("retailer"), _unescape(F.coalesce(text.filled(ld("$.name")), C("og_title"))).alias("title"),
                    text.clean_image_url(_unescape(F.coalesce(text.filled(first_image), C("og_image"), F.lit("")))).alias("image_url"), scores.parse_price(price).alias("price"),
                    _unescape(F.substring(F.coalesce(text.filled(ld("$.description")), C("og_text"), F.lit("")), 1, 500)).alias("description"),
                    F.coalesce(_unescape(plain(ld("$.color"))), F.lit("")).alias("color"), F.coalesce(_unescape(plain(ld("$.material"))), F.lit("")).alias("material"),
                    F.coalesce(plain(ld("$.category")), F.lit("")).alias("__cat"), F.coalesce(text.filled(ld("$.sku")), text.filled(ld("$.productID"))).alias("__sku"))
    rows = rows.where("title IS NOT NULL AND title <> '' AND image_url LIKE 'http%'")
    rows = rows.withColumn("__text", F.concat_ws(" ", "title", "description", "color", "__cat")).where(~text.is_mens(C("__text"), mode="words"))
    rows = rows.withColumn("object_id", text.object_id("html", C("retailer"), F.coalesce("__sku", text.slugify(C("title"))), slug=True)).withColumn("brand", C("retailer"))
    rows = rows.withColumn("images", F.array("image_url"))
    category = F.coalesce(text.category_from_title(C("title"), None, None), text.filled(text.slugify(C("__cat"))), F.lit("other"))
    return finish(rows, C("__text"), category)


def url_ok(url: Column) -> Column:
    return ~url.rlike(vocab.URL_SKIP) & url.rlike(vocab.URL_KEEP)


def sitemap_urls(xml: DataFrame, col: str = "xml", filtered: bool = True) -> DataFrame:
    """(kind, url) of downloaded sitemap texts: nested sitemaps and page locations."""
    def locs(tag):
        return F.regexp_extract_all(C(col), F.lit(rf"(?s)<{tag}>.*?<loc>([^<]+)</loc>"), 1)

    rows = xml.select(F.explode(F.concat(F.transform(locs("sitemap"), lambda u: F.struct(F.lit("sitemap").alias("kind"), F.replace(u, F.lit("&amp;"), F.lit("&")).alias("url"))),
                                         F.transform(locs("url"), lambda u: F.struct(F.lit("page").alias("kind"), F.replace(u, F.lit("&amp;"), F.lit("&")).alias("url"))))).alias("l"))
    rows = rows.select("l.kind", "l.url")
    return rows.where((C("kind") == "sitemap") | url_ok(C("url"))) if filtered else rows


def offer_color_explode(products: DataFrame, offers: str = "offer_urls") -> DataFrame:
    """One product per distinct `?Color=` value of its offer URLs, first seen first; products without colours stay one row."""
    raw = F.transform(F.filter(offers, lambda u: u.rlike(r"(?i)[?&]Color=[^&#]+")), lambda u: F.trim(F.try_url_decode(F.regexp_extract(u, r"(?i)[?&]Color=([^&#]+)", 1))))
    distinct = F.filter(raw, lambda c, i: F.array_position(F.transform(raw, F.lower), F.lower(c)) == i + 1)
    rows = products.withColumn("color", F.explode_outer(F.when(F.size(distinct) > 0, distinct)))
    has = C("color").isNotNull()
    slug = text.slugify(C("color"))
    repeat = F.lower("title").contains(F.lower("color"))
    return rows.select(F.when(has, F.concat_ws("-", "object_id", text.filled(slug))).otherwise(C("object_id")).alias("object_id"),
                       F.when(has & ~repeat, F.concat("title", F.lit(" — "), "color")).otherwise(C("title")).alias("title"), F.coalesce("color", F.lit("")).alias("color"),
                       F.when(has, F.concat("product_url", F.lit("?Color="), F.replace(F.url_encode("color"), F.lit("+"), F.lit("%20")))).otherwise(C("product_url")).alias("product_url"),
                       *[c for c in products.columns if c not in ("object_id", "title", "color", "product_url", offers)])


CURATION_SCHEMA = ("ts STRING, dna_hash STRING, dna_summary STRING, primary STRING, secondary STRING, price_range STRING, candidate_ids ARRAY<STRING>, kept_ids ARRAY<STRING>, "
                   "rejected_ids ARRAY<STRING>, board_image_urls ARRAY<STRING>")


def curation_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines to the curation log: unreadable lines dropped, missing fields defaulted."""
    r = lines.select(F.from_json(F.trim(C(col)), CURATION_SCHEMA + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    r = r.where(C("r").isNotNull() & C("r._bad").isNull())
    empty = F.array().cast("array<string>")
    names = {"dna_hash": ("dna_hash", ""), "dna_summary": ("dna_summary", ""), "primary": ("primary_aesthetic", ""), "secondary": ("secondary_aesthetic", ""), "price_range": ("price_range", "mid")}
    return r.select(C("r.ts").try_cast("timestamp").alias("created_at"), *[F.coalesce(C(f"r.{k}"), F.lit(d)).alias(n) for k, (n, d) in names.items()],
                    *[F.coalesce(C(f"r.{k}"), empty).alias(k) for k in ("candidate_ids", "kept_ids", "rejected_ids", "board_image_urls")])


def curation_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return curation_lines(spark.read.text(path))


def source_fallback(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """The primary store, or the backup when the primary has no row. One row is looked for, nothing is counted."""
    return backup if primary.isEmpty() else primary


def browse(catalog: DataFrame, condition: Column | None, columns: Sequence[str]) -> DataFrame:
    """Filtered catalogue scan of the listed columns; the filter and the column list reach the file scan."""
    return (catalog if condition is None else catalog.where(condition)).select(*columns)
