"""Catalogue, vector and log sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modiste.session import cut, shared_dir

C = F.col


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_dir(spark)}/modiste/{name}-{uuid.uuid4().hex}"


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """`old` with the rows of `new` put in: all columns, or only the listed ones for existing rows; deleted ids removed."""
    cols = [c for c in old.columns if c not in keys]
    changed = set(cols if columns is None else columns)
    n = new.select(*keys, *[C(c).alias(f"__n_{c}") for c in cols if c in new.columns], F.lit(True).alias("__new"))
    j = old.withColumn("__old", F.lit(True)).join(n, list(keys), "full")

    def value(c):
        if c not in new.columns:
            return C(c)
        take = C("__new") & (F.lit(True) if c in changed else C("__old").isNull())
        return F.when(take, C(f"__n_{c}")).otherwise(C(c)).alias(c)

    out = j.select(*keys, *[value(c) for c in cols]).select(*old.columns)
    return out if deletes is None else out.join(deletes.select(*keys), list(keys), "left_anti")


def upsert_vectors(vectors: DataFrame, path: str, buckets: int = 64) -> None:
    """Put vectors (object_id, namespace, vec, metadata…) into the store at `path` by (namespace, object_id); others stay.

    The store is partitioned by namespace and a hash bucket of the id. Only buckets that the batch touches are read, merged and
    replaced; the merge is written aside first, so a lost task never meets a half-replaced bucket. `buckets` belongs to the store.
    """
    spark = vectors.sparkSession
    keys = ["namespace", "object_id"]
    new = cut(vectors.withColumn("bucket", F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        touched = new.select("namespace", "bucket").distinct()
        old = spark.read.schema(new.schema).parquet(path).join(touched, ["namespace", "bucket"], "left_semi").select(*new.columns)
        new = cut(old.join(new.select(*keys), keys, "left_anti").unionByName(new))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "bucket").parquet(path)


def append_jsonl(entries: DataFrame, path: str, batch: str) -> None:
    """Append entries to the log at `path` as the batch of that name; a batch that is written again replaces what it had written."""
    entries.write.mode("overwrite").json(f"{path}/batch={batch}")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a log of batches."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def stream_jsonl(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of entries to the log at `path`, to the end of what is there; returns the finished query.

    The folder's own log of committed files goes with the checkpoint's log of micro-batches: a micro-batch that is run again after a failure finds itself
    committed, or its files don't count, so each entry is read once. Read such a log with `spark.read.json(path)`."""
    q = stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
