"""Registered queries of the operators, over whole tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modiste.llm import bpe, decontaminate, html, langid, lines, lm, quality, sharding, simhash, suffix, topk, trie, whitening
from modiste.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    code = bpe.coder(spark, public_tokenizers.path("byte_bpe_50k.json"), "n_tokens", "ids_sha256", "decoded_sha256")
    return stored(docs.select("doc_id", code("text").alias("c")).select("doc_id", "c.*"), "bpe-digests")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out."""
    out = suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "__cut.n_removed", "__cut.n_spans", F.sha2("__cut.kept", 256).alias("kept_sha256"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the groups of documents linked by them."""
    out = simhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("h")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards near equal in bytes."""
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents are dropped everywhere."""
    out = lines.dropped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2(F.col("__lines.text").cast("binary"), 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of four fifths of them."""
    return langid.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the conversations, each rebuilt on the head of another."""
    return trie.described(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 32 components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model of two thirds of the labels."""
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), met AS (
  SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.phrase = win.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, generate_subscripts(ls, 1) AS nr, unnest(ls) AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT r, doc_id, nr, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY r, doc_id
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') || chr(0) || coalesce(text, '') AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '') || chr(0) || coalesce(text, '')) AS nr
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(said ORDER BY nr) AS said, list(words ORDER BY nr) AS words,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                         lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1 : c.h], []), c.said[c.h + 1 :]) AS said, list_concat(coalesce(b.words[1 : c.h], []), c.words[c.h + 1 :]) AS words
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, d, md5(CAST(said[1 : d] AS VARCHAR)) AS k, md5(CAST(said[1 : d - 1] AS VARCHAR)) AS up, coalesce(words[d], 0) AS words, d = len(said) AS ends
  FROM (SELECT *, unnest(generate_series(0, len(said))) AS d FROM r)
), n AS (
  SELECT d, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended
  FROM p GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), below AS (
  SELECT p.d, p.k, sum(n.saved) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM n JOIN (SELECT conv_id, d, k FROM p) p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM n JOIN below ON below.d = n.d AND below.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN n a ON n.d > 0 AND a.d = n.d - 1 AND a.k = n.up
"""

QUERIES: dict[str, Query] = {"op1_bpe": op1_bpe, "op2_suffix": op2_suffix, "op3_lm": op3_lm, "op4_simhash": op4_simhash, "op5_decontaminate": op5_decontaminate, "op6_sharding": op6_sharding, "op7_topk": op7_topk, "op8_lines": op8_lines, "op9_langid": op9_langid, "op10_html": op10_html, "op11_trie": op11_trie, "op12_whitening": op12_whitening, "op13_quality": op13_quality}
ORACLES: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op7_topk": OP7_SQL, "op8_lines": OP8_SQL, "op11_trie": OP11_SQL}
