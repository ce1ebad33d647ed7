"""Line dedup with two Bloom filters.

A line's key is the line without white space at both ends, A-Z in lower case. Pass one fills the filters with the keys of every
document; pass two lets only keys through that the twice-filter holds, counts their documents exactly and picks the first; pass three
drops the lines. Keys in few documents never leave the task that reads them.

Every row is a document, also where a doc_id repeats; a line counts once per row. Null and empty texts have one empty line. Keys
shorter than `min_chars` code points always stay. Rows with null doc_ids are documents like any other. Other columns pass through.

`without_boilerplate` is the form for a pipeline: what a document consists of isn't lost with its copies, one row keeps it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.llm.common import discard, in_runs, release, sliced, stored, texts_of, unused
from modiste.llm.hashfilter import Twice, seen_twice

KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """Distinct keys that may be dropped. Python's strip and lower of bytes are those of the rule: ASCII white space, A-Z."""
    keys = {line.strip() for line in text.lower().split(b"\n")}
    return {k for k in keys if len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars}


def repeated_keys(docs: DataFrame, min_chars: int, bits: int, k: int) -> Twice:
    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(key) for part in sliced([batch]) for text in texts_of(part.column(0)) for key in keys_of(text, min_chars)), np.uint64)

    return seen_twice(docs.select("text"), hashes, bits, k)


def suspects_in(twice: Broadcast, min_chars: int) -> Callable[..., Column]:
    """The distinct keys of a text that the twice-filter holds, as a column function."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    @in_runs
    def suspects(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts_of(texts):
            keys = list(keys_of(text, min_chars))
            known = twice.value.has(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
            out.append([key for key, on in zip(keys, known) if on])
        return pa.array(out, pa.list_(pa.binary()))

    return suspects


@F.arrow_udf(KEPT)
@in_runs
def without(texts: pa.Array, drop: pa.Array, first: pa.Array) -> pa.Array:
    kept, lines_, dropped_ = [], [], []
    for text, gone, once in zip(texts_of(texts), drop.to_pylist(), first.to_pylist()):
        lines = text.split(b"\n")
        if gone:
            gone, once = set(gone), set(once or ())
            rest = []
            for line in lines:
                key = line.lower().strip()
                if key not in gone:
                    rest.append(line)
                elif key in once:
                    once.discard(key)
                    rest.append(line)
        else:
            rest = lines
        kept.append(b"\n".join(rest))
        lines_.append(len(lines))
        dropped_.append(len(lines) - len(rest))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped_, pa.int64())], ["text", "n_lines", "n_dropped"])


def common_keys(found: DataFrame, min_docs: int) -> DataFrame:
    """(__key, __first): keys of at least `min_docs` rows of `found`, with the smallest doc_id."""
    common = found.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    return stored(common.where(F.col("__n") >= min_docs).select("__key", "__first"), "lines")


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int = 1 << 26, k: int = 2, out: str = "__lines") -> DataFrame:
    """`docs` with a struct `out` (text, n_lines, n_dropped): each text without the lines whose key is in at least `min_docs` documents.
    With `keep_first` the first line of such a key stays, in the document with the smallest doc_id."""
    twice = docs.sparkSession.sparkContext.broadcast(repeated_keys(docs, min_chars, bits, k))
    suspects = suspects_in(twice, min_chars)

    found = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), suspects("text").alias("__keys"))
    found = stored(found.select("__id", "__h", F.explode("__keys").alias("__key")), "line-suspects")
    common = common_keys(found, min_docs)
    first = F.when(F.lit(keep_first) & F.col("__id").eqNullSafe(F.col("__first")), F.col("__key"))
    gone, once, id_, h, own = unused(docs, "drop", "once", "id", "h", "own")
    drop = found.join(common, "__key").groupBy(F.col("__id").alias(id_), F.col("__h").alias(h)).agg(F.collect_set("__key").alias(gone), F.collect_set(first).alias(once))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    joined = keyed.join(drop, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(h)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], without("text", gone, once).alias(out))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The columns of `docs`, with the text that is left."""
    left = unused(docs, "left")
    out = dropped_lines(docs, out=left, **how)
    return out.select(*[F.col(f"{left}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def without_boilerplate(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, bits: int = 1 << 26, k: int = 2) -> DataFrame:
    """The columns of `docs`, without the lines whose key is in at least `min_docs` documents. A row of whose keys such ones make up half or more,
    in bytes, has copies rather than boilerplate: each of its keys stays once, in the first such row (smallest doc_id, then text)."""
    row, gone, once, left = unused(docs, "row", "drop", "once", "left")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    twice = docs.sparkSession.sparkContext.broadcast(repeated_keys(rows, min_chars, bits, k))
    suspects = suspects_in(twice, min_chars)

    @F.arrow_udf(T.LongType())
    @in_runs
    def bytes_of_keys(texts: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, keys_of(text, min_chars))) for text in texts_of(texts)], pa.int64())

    found = rows.select(F.col(row).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), bytes_of_keys("text").alias("__size"), suspects("text").alias("__keys"))
    found = stored(found.select("__row", "__id", "__h", "__size", F.explode("__keys").alias("__key")), "line-suspects")
    met = stored(found.join(common_keys(found, min_docs).select("__key"), "__key"), "common-lines")
    copies = met.groupBy("__row").agg(F.sum(F.octet_length("__key")).alias("__n"), F.first("__size").alias("__size")).where(2 * F.col("__n") >= F.col("__size"))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__row").alias("row"))
    held = met.join(stored(copies.select("__row"), "copied-rows"), "__row").groupBy("__key").agg(F.min(order).alias("__min"))
    held = stored(held.select("__key", F.col("__min.row").alias("__holder")), "held-lines")
    kept = F.when(F.col("__row") == F.col("__holder"), F.col("__key"))
    drop = met.join(held, "__key", "left").groupBy(F.col("__row").alias(row)).agg(F.collect_set("__key").alias(gone), F.collect_set(kept).alias(once))
    joined = rows.join(drop, row, "left").withColumn(left, without("text", gone, once))
    out = stored(joined.select(*[F.col(f"{left}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]), "without-boilerplate")
    discard(rows, found, met, held)
    release(docs.sparkSession)
    return out
