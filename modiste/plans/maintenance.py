"""Catalogue upkeep: audits, purges, deletions, increments and reports. Every job returns DataFrames; writing is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modiste import vocab
from modiste.functions import scores
from modiste.operators.joins import rule_theta
from modiste.scale import numbered, without

C = F.col


def fx_normalize(products: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Dollar price and new bucket for the listed brands; the bounded rate table is a map literal, so nothing is shuffled."""
    rates = rates or vocab.BRAND_RATES
    rate = F.create_map(*[x for b, r in rates.items() for x in (F.lit(b), F.lit(float(r)))])[C("brand")]
    rows = products.where(C("brand").isin(list(rates)) & (C("price") > 0)).withColumn("new_price", scores.fx_price(C("price"), rate))
    return rows.withColumn("new_range", scores.price_bucket(C("new_price")))


def mistag_audit(products: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """(flagged rows with rule/action/target, the catalogue after applying them)."""
    flagged = rule_theta(products, rules)
    from modiste.operators.joins import rule_hit

    hit = rule_hit(C("title"), C("category"), rules)
    tagged = products.withColumn("__hit", hit)
    fixed = tagged.where(C("__hit").isNull() | (C("__hit.action") != "delete")).withColumn("category", F.coalesce("__hit.target", "category")).drop("__hit")
    return flagged, fixed


def price_purge(products: DataFrame, vectors: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """Backup, remaining products and vectors, and a report per brand."""
    over = products.where(C("price") > threshold)
    ids = over.select("object_id")
    report = over.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("max_price"))
    return {"backup": over, "products": products.where(C("price").isNull() | (C("price") <= threshold)), "vectors": vectors.join(ids, "object_id", "left_anti"), "report": report}


def delete_reason(targets: Sequence[tuple[str, str]], ids: Sequence[str] = ()) -> Column:
    """Why a row goes: zero price, then a brand/title substring pair (the last one that fits), then an explicit id."""
    reason = None
    for brand, title in reversed(list(targets)):
        hit = F.lower(C("brand")).contains(brand.lower()) & F.lower(C("title")).contains(title.lower())
        text = f"title: {brand} / {title}"
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    zero = C("price") == 0
    reason = F.when(zero, "price=$0") if reason is None else reason.when(zero, "price=$0")
    return reason.when(C("object_id").isin(list(ids)), "listed") if ids else reason


def delete_targets(products: DataFrame, targets: Sequence[tuple[str, str]], ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to delete with reason, the rest, counts per reason) in one pass over the catalogue each."""
    tagged = products.withColumn("reason", delete_reason(targets, ids))
    gone = tagged.where(C("reason").isNotNull())
    return gone, tagged.where(C("reason").isNull()).drop("reason"), gone.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def delete_by_query(products: DataFrame, vectors: DataFrame, text: str, most: int = 1000) -> dict[str, DataFrame]:
    """What a keyword search for `text` finds, at most `most` of it as the index does, goes from catalogue and vectors."""
    from modiste.plans.retrieval import keyword_search

    query = products.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
    hits = keyword_search(query, products, most).select("object_id")
    return {"deleted": products.join(hits, "object_id", "left_semi"), "products": products.join(hits, "object_id", "left_anti"), "vectors": vectors.join(hits, "object_id", "left_anti")}


def incremental(todo: DataFrame, done: DataFrame, key: str = "object_id") -> DataFrame:
    return without(todo, done, [key])


def ghost_report(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Vector hits without a catalogue row."""
    return hits.join(products.select("object_id"), "object_id", "left_anti")


def brand_purge(products: DataFrame, vectors: DataFrame, brand: str) -> dict[str, DataFrame]:
    """Rows of one brand and their vectors in every namespace, removed and kept."""
    gone = products.where(C("brand") == brand)
    ids = gone.select("object_id")
    return {"deleted": gone, "products": products.where(C("brand").isNull() | (C("brand") != brand)), "deleted_vectors": vectors.join(ids, "object_id", "left_semi"),
            "vectors": vectors.join(ids, "object_id", "left_anti")}


def backfill_page(entries: DataFrame, page: int, size: int, excluded: Sequence[str], boards: str = "boards", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """One newest-first page, entries with an excluded board name skipped."""
    low = [x.lower() for x in excluded]
    fine = entries.where(~F.exists(C(boards), lambda b: F.lower(b).isin(low)))
    newest = [C(ts).desc(), C(tie).desc()]
    head = fine.orderBy(*newest).limit((page + 1) * size)  # a page and those before it
    ranked = numbered(head, [], newest, "position", spread=False)
    return ranked.where((C("position") > page * size) & (C("position") <= (page + 1) * size))
