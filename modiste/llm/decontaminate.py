"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

Test phrases are looked up from their rarest term: training counts of all test terms pick it, and only for those terms postings are stored:
(term, document, position), each with the terms around it. Intersecting with the lists of the phrase's other terms at their offsets
is then a comparison inside the posting instead of a join per term. Exact phrases and proximity (all terms within a span) read the
same postings. Joins are left to Spark, which knows the true sizes of stored tables.

Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z. Null and empty texts have no words. Every row of documents is
judged by its own text, also where a doc_id repeats or is null. Items without words or without an id match nothing; items may share
windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modiste.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words; capitals are lower-cased after splitting, where few words have any
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other characters as they are. A word that lower() leaves alone has no A-Z."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: str) -> Column:
    """The words as written; the first and the last may be empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN)


def word_count(text: str) -> Column:
    words = raw_words(text)
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int") - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def windows(items: DataFrame, width: int) -> DataFrame:
    """(phrase, item_id, words): distinct runs of `width` words of each item; a shorter item is one run."""
    words = items.where("item_id IS NOT NULL").select("item_id", F.transform(F.filter(raw_words("text"), lambda w: w != ""), lowered).alias("all"))
    starts = words.where(F.size("all") > 0).select("item_id", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))).alias("at"))
    runs = starts.select("item_id", F.slice("all", F.col("at"), F.lit(width)).alias("words"))
    return runs.select(F.array_join("words", " ").alias("phrase"), "item_id", "words").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) of the given terms over all of `docs`."""
    tokens = docs.select(F.explode(raw_words("text")).alias("w")).select(lowered(F.col("w")).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def probes(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, offset, len, phrase): the rarest term of each phrase and where it stands. Phrases with a term that no document has are gone."""
    terms = phrases.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("offset", "term"))
    rare = terms.join(counts, "term").groupBy("phrase", "len").agg(F.min(F.struct("n", "term", "offset")).alias("rare"), F.count(F.lit(1)).alias("found"))
    return rare.where("found = len").select("rare.term", "rare.offset", "len", "phrase")


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(term, doc_id, h, pos, at, around): every place of the given terms, with up to `reach` words on either side; `around[at]` is the term."""
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), raw_words("text").alias("words"))
    tokens = words.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "w")).withColumn("term", lowered(F.col("w")))
    begin = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.transform(F.slice("words", begin + 1, F.col("pos") - begin + reach + 1), lowered)
    return tokens.join(terms, "term").select("term", "doc_id", "h", "pos", (F.col("pos") - begin).alias("at"), around.alias("around"))


def phrase_matches(index: DataFrame, probes_: DataFrame) -> DataFrame:
    """(doc_id, h, start, len, phrase): exact occurrences."""
    begin = F.col("at") - F.col("offset")
    met = index.join(probes_, "term").where((begin >= 0) & (begin + F.col("len") <= F.size("around")))
    met = met.where(F.array_join(F.slice("around", begin + 1, F.col("len")), " ") == F.col("phrase"))
    return met.select("doc_id", "h", (F.col("pos") - F.col("offset")).alias("start"), "len", "phrase")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(doc_id, h, pos, phrase): places of a phrase's rarest term with all its other terms, in any order, within some `span` words
    that hold the place. `phrases` has (phrase, words)."""
    terms = stored(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    rare = stored(probes(phrases, stored(term_counts(docs, terms), "term-counts")), "probes")
    index = postings(docs, rare.select("term").distinct(), span - 1)
    met = index.join(rare, "term").join(phrases.select("phrase", "words"), "phrase")
    window = lambda i: F.slice("around", i + 1, F.lit(span))
    first = F.sequence(F.greatest(F.lit(0), F.col("at") - span + 1), F.col("at"))
    return met.where(F.exists(first, lambda i: F.size(F.array_except("words", window(i))) == 0)).select("doc_id", "h", "pos", "phrase").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs`; h is xxhash64 of the text. A row is contaminated if a word
    is hit and at least one in `share` is."""
    held = stored(windows(items, width), "windows")
    phrases = held.select("phrase", "words").distinct()
    terms = stored(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    rare = stored(probes(phrases, stored(term_counts(docs, terms), "term-counts")), "probes")
    index = stored(postings(docs, stored(rare.select("term").distinct(), "rare-terms"), width - 1), "postings")
    met = stored(phrase_matches(index, rare), "matches")

    key = ["doc_id", "h"]
    spans = met.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    of = met.select(*key, "phrase").distinct().join(held.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase")
    of = of.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hits.join(of, hits["doc_id"].eqNullSafe(of["doc_id"]) & (hits["h"] == of["h"])).select(hits["doc_id"].alias("__id"), hits["h"].alias("__h"), "n_hit", "items")

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), word_count("text").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["h"] == F.col("__h")), "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that aren't contaminated."""
    bad = contamination(docs.select("doc_id", "text"), items, **how).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    bad = stored(bad, "contaminated")
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__id"]) & (keyed["__key"] == bad["__h"]), "left_anti").drop("__key")
