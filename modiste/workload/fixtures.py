"""Views over the given tables, once as DataFrames and once as SQL text for the twin engine.

Every view maps whole tables (no row filters to keep it small): parts are the catalogue, embeddings the vectors, events the
signal log, suppliers the query log (each supplier asks for its own flagship part).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modiste import vocab
from modiste.scale import spread_small

AS_OF = "2024-01-31 00:00:00"

# ── SQL shared by both engines ────────────────────────────────────────────────
PRODUCTS = """
SELECT concat('p-', CAST(p_partkey AS VARCHAR(20))) AS object_id, p_partkey AS pos, p_name AS title, p_brand AS brand,
       concat('r-', CAST(p_partkey % 10 AS VARCHAR(20))) AS retailer,
       CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE CAST((p_partkey * 37) % 400 AS DOUBLE) END AS price,
       CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN split_part(p_name, ' ', 1) ELSE '' END AS color,
       lower(p_type) AS material,
       concat(p_name, ' ', lower(p_type), ' size ', CAST(p_size AS VARCHAR(20))) AS description,
       CASE p_type WHEN 'STANDARD' THEN 'dress' WHEN 'PROMO' THEN 'top' WHEN 'ECONOMY' THEN 'bottom'
                   WHEN 'MEDIUM' THEN 'jacket' WHEN 'SMALL' THEN 'shoes' ELSE 'bag' END AS category,
       CASE WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 10 = 6 THEN 'https://img.example.com/placeholder.gif'
            ELSE concat('https://img.example.com/items/', CAST(p_partkey AS VARCHAR(20)), '.jpg') END AS image_url,
       CASE split_part(p_name, ' ', 1) WHEN 'hot' THEN 'edgy' WHEN 'cold' THEN 'minimalist' WHEN 'new' THEN 'casual'
            WHEN 'old' THEN 'preppy' WHEN 'small' THEN 'mini' WHEN 'large' THEN 'maxi' ELSE '' END AS tag,
       CASE WHEN p_partkey % 50 = 7 OR (p_partkey * 37) % 400 = 0 THEN 'unknown' WHEN (p_partkey * 37) % 400 < 50 THEN 'budget'
            WHEN (p_partkey * 37) % 400 < 150 THEN 'mid' ELSE 'luxury' END AS price_range,
       p_size AS size
FROM {part}"""

QUERY_LOG = """
SELECT pos AS query_id, CASE WHEN price < 100 THEN concat(lower(brand), ' ', title) WHEN price < 200 THEN concat(title, ' ', category)
                             ELSE title END AS text
FROM {products}"""

SIGNALS = """
SELECT event_id, concat('u-', CAST(user_id AS VARCHAR(20))) AS user_token, concat('p-', {k}) AS object_id, {ts} AS ts,
       concat(CAST(user_id AS VARCHAR(20)), '|', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS session_id, value * 100 AS dwell_ms,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'save'
                       WHEN 'signup' THEN 'like' ELSE 'dislike' END AS kind
FROM {events}"""

STEERS = """
SELECT s.event_id, s.user_token, s.ts, p.object_id,
       CASE s.kind WHEN 'click' THEN concat('Black dresses, more ', p.title) WHEN 'impression' THEN concat('cheaper blazers, no ', p.title)
            WHEN 'save' THEN concat('under $', CAST(p.pos * 13 + 20 AS VARCHAR(20)), ' and ', p.title)
            WHEN 'like' THEN concat('more linen, less denim and ', p.title, 's without florals')
            ELSE CASE WHEN p.pos < 30 THEN 'edgier' WHEN p.pos < 60 THEN concat('over $', CAST(p.pos * 10 AS VARCHAR(20))) ELSE '' END
       END AS raw_text
FROM {signals} s JOIN {products} p ON s.object_id = p.object_id"""

# ── SQL of the twin engine ────────────────────────────────────────────────────
TWIN = {
    "products": PRODUCTS.format(part="part"),
    "query_log": QUERY_LOG.format(products="products"),
    "vectors": "SELECT concat('p-', CAST(vec_id AS VARCHAR)) AS object_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "units": "SELECT object_id, vec_id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM vectors",
    "vibes": "SELECT object_id, list_reverse(vec) AS vec FROM vectors WHERE label < 5",
    "axes": "SELECT object_id, " + ", ".join(
        f"least(1.0, greatest(0.0, 0.5 + 2 * vec[{i}])) AS {a}" for i, a in enumerate(vocab.AXES, 1)) + " FROM vectors",
    "signals": SIGNALS.format(events="events", k="json_extract_string(props, '$.k')", ts="ts"),
    "steers": STEERS.format(signals="signals", products="products"),
    "queries": """SELECT s_suppkey AS query_id, p_name AS text, v.vec AS vec, concat('u-', CAST(s_suppkey AS VARCHAR)) AS user_token,
                         CASE WHEN s_acctbal < 3000 THEN 'budget' WHEN s_acctbal < 7000 THEN 'mid' ELSE 'luxury' END AS price_range,
                         CASE WHEN s_acctbal < 5000 THEN 'rod' ELSE '' END AS avoid
                  FROM supplier JOIN part ON p_partkey = s_suppkey JOIN vectors v ON v.vec_id = s_suppkey""",
    "phrases": """SELECT q.query_id, x.phrase, v.vec FROM queries q, (VALUES (1), (2), (3), (4)) x(phrase), vectors v
                  WHERE v.vec_id = q.query_id + x.phrase""",
}


def twin_sql(body: str) -> str:
    """Prefix `body` with the fixture views it mentions, directly or through other views."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in TWIN:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(TWIN[name])

    visit(body)
    ctes = ", ".join(f"{n} AS ({q})" for n, q in TWIN.items() if n in need)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


class Env:
    """The fixture views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return spread_small(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    @cached_property
    def products(self) -> DataFrame:
        return self.spark.sql(PRODUCTS, part=self.table("part"))

    @cached_property
    def query_log(self) -> DataFrame:
        return self.spark.sql(QUERY_LOG, products=self.products)

    @cached_property
    def tagged(self) -> DataFrame:
        """Products with `aesthetic_tags`."""
        return self.products.withColumn("aesthetic_tags", F.array_compact(F.array(F.when(F.col("tag") != "", F.col("tag")))))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.concat(F.lit("p-"), F.col("vec_id").cast("string")).alias("object_id"), "vec_id",
                                               "label", F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def vibes(self) -> DataFrame:
        return self.vectors.where("label < 5").select("object_id", F.reverse("vec").alias("vec"))

    @cached_property
    def axes(self) -> DataFrame:
        cols = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * F.get("vec", F.lit(i)))).alias(a) for i, a in enumerate(vocab.AXES)]
        return self.vectors.select("object_id", *cols)

    @cached_property
    def signals(self) -> DataFrame:
        sql = (SIGNALS.replace("{k}", "get_json_object(props, '$.k')").replace("{ts}", "CAST(ts AS TIMESTAMP)"))
        return self.spark.sql(sql, events=self.table("events"))

    @cached_property
    def steers(self) -> DataFrame:
        return self.spark.sql(STEERS, signals=self.signals, products=self.products)

    @cached_property
    def queries(self) -> DataFrame:
        s, p, v = self.table("supplier"), self.table("part"), self.vectors
        tier = F.when(F.col("s_acctbal") < 3000, "budget").when(F.col("s_acctbal") < 7000, "mid").otherwise("luxury")
        return (s.join(p, p["p_partkey"] == s["s_suppkey"]).join(v, v["vec_id"] == s["s_suppkey"])
                .select(F.col("s_suppkey").alias("query_id"), F.col("p_name").alias("text"), "vec",
                        F.concat(F.lit("u-"), F.col("s_suppkey").cast("string")).alias("user_token"), tier.alias("price_range"),
                        F.when(F.col("s_acctbal") < 5000, "rod").otherwise("").alias("avoid")))

    @cached_property
    def phrases(self) -> DataFrame:
        q = self.queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("phrase"))
        v = self.vectors.select("vec_id", "vec")
        return q.join(v, F.col("vec_id") == F.col("query_id") + F.col("phrase")).select("query_id", "phrase", "vec")


# ── registry ──────────────────────────────────────────────────────────────────
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query and, when SQL can express it over whole tables, its twin."""

    def register(fn: Callable[[Env], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = lambda spark, folder: fn(Env(spark, folder))
        if sql is not None:
            ORACLES[key] = twin_sql(sql)
        return fn

    return register


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def r6(expr: str) -> str:
    """Six decimals without a negative zero."""
    return f"(round({expr}, 6) + 0.0)"


def r6c(col):
    return F.round(col, 6) + F.lit(0.0)
