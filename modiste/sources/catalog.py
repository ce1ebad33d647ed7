"""The product catalogue as a store of hash buckets with published versions.

    path/data/<version>/bucket=<k>/*.parquet    rows of a bucket, as that version has written them
    path/manifests/<number>.json                the folder of each bucket, schema, key and number of buckets

An upsert reads and writes only the buckets its ids fall into; other buckets stay where they are. Its version is published by the rename of one manifest,
readers take the manifest with the highest number, and an upsert that fails leaves nothing that a reader sees. The version before stays for readers that
have begun with it, older ones go.

Up to SMALL changed rows, counted before, are sent to the tasks that read the old rows, so these aren't shuffled; more than that are joined by shuffles
of the touched buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modiste.sources.sinks import upserted

C = F.col
BUCKETS = 64
#: changed rows that are sent to every task
SMALL = 500_000
#: files of a bucket from which an upsert writes it anew as one
MANY_FILES = 8


@dataclass
class Version:
    """A published version: number, key, number of buckets, schema, folder of each bucket that has rows."""

    number: int
    key: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the manifests, oldest first."""
    return [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]


def version(spark: SparkSession, path: str, name: str | None = None) -> Version | None:
    """The version of a manifest, the newest one by default; None if nothing is published."""
    name = name or (published(spark, path) or [None])[-1]
    if name is None:
        return None
    said = json.loads(spark.read.text(f"{path}/manifests/{name}", wholetext=True).first()[0])
    return Version(int(name.split(".")[0]), said["key"], said["buckets"], T.StructType.fromJson(said["schema"]), {int(k): v for k, v in said["folders"].items()})


def _publish(spark: SparkSession, path: str, v: Version) -> None:
    fs, target = _fs(spark, f"{path}/manifests/{v.number:010d}.json")
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(hidden)
    out.write(bytearray(json.dumps({"key": v.key, "buckets": v.buckets, "schema": json.loads(v.schema.json()), "folders": v.folders}).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(hidden, target):
        fs.delete(hidden, False)
        raise RuntimeError(f"version {v.number} has been published by another writer")


def _write(rows: DataFrame, path: str, number: int, buckets: int, key: str) -> dict[int, str]:
    """The folders of the buckets that got rows."""
    at = f"data/{number:010d}-{uuid.uuid4().hex[:8]}"
    rows.withColumn("bucket", bucket_of(key, buckets)).write.partitionBy("bucket").parquet(f"{path}/{at}")
    return {int(n.split("=")[1]): f"{at}/{n}" for n in _names(rows.sparkSession, f"{path}/{at}") if n.startswith("bucket=")}


def create(rows: DataFrame, path: str, key: str = "object_id", buckets: int = BUCKETS) -> Version:
    """Publish `rows`, unique by `key`, as the first version of a store or as the next one that replaces all rows."""
    spark = rows.sparkSession
    before = version(spark, path)
    number = before.number + 1 if before else 1
    v = Version(number, key, buckets, rows.schema, _write(rows.repartition(buckets, bucket_of(key, buckets)), path, number, buckets, key))
    _publish(spark, path, v)
    _clean(spark, path)
    return v


def read(spark: SparkSession, path: str, v: Version | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, the newest by default, or of some of its buckets."""
    v = v or version(spark, path)
    folders = [f"{path}/{at}" for k, at in sorted(v.folders.items()) if only is None or k in only]
    return spark.read.schema(v.schema).parquet(*folders) if folders else spark.createDataFrame([], v.schema)


def _clean(spark: SparkSession, path: str) -> None:
    """Remove all manifests but the last two, and the folders none of these two names."""
    names = published(spark, path)
    kept = {at for n in names[-2:] for at in version(spark, path, n).folders.values()}
    for n in names[:-2]:
        for at in set(version(spark, path, n).folders.values()) - kept:
            fs, old = _fs(spark, f"{path}/{at}")
            fs.delete(old, True)
            if not any(f.startswith("bucket=") for f in _names(spark, f"{path}/{at.rsplit('/', 1)[0]}")):
                fs.delete(old.getParent(), True)
        fs, old = _fs(spark, f"{path}/manifests/{n}")
        fs.delete(old, False)


def upsert(spark: SparkSession, path: str, new: DataFrame, columns: Sequence[str] | None = None, deletes: DataFrame | None = None, small: int = SMALL) -> Version:
    """Publish the next version: `new`, unique by key, put in (all columns, or of rows that exist only the listed ones), the ids of `deletes` removed."""
    v = version(spark, path)
    key = v.key
    gone = None if deletes is None else deletes.select(key).distinct()
    new = new if gone is None else new.join(gone, key, "left_anti")
    ids = new.select(key, F.lit(1).alias("n")) if gone is None else new.select(key, F.lit(1).alias("n")).unionByName(gone.select(key, F.lit(1).alias("n")))
    counts = ids.groupBy(bucket_of(key, v.buckets).alias("bucket")).agg(F.sum("n").alias("n")).collect()  # a row per bucket at most
    touched = sorted(r.bucket for r in counts)
    if not touched:
        return v
    old = read(spark, path, v, touched)
    if sum(r.n for r in counts) <= small:
        left = old if gone is None else old.join(F.broadcast(gone), key, "left_anti")
        cols = [c for c in v.schema.names if c != key]
        take = [c for c in cols if c in new.columns and (columns is None or c in columns)]
        change = F.broadcast(new.select(C(key), *[C(c).alias(f"__n_{c}") for c in take], F.lit(True).alias("__new")))
        changed = left.join(change, key, "left").select(*[F.when(C("__new"), C(f"__n_{c}")).otherwise(C(c)).alias(c) if c in take else C(c) for c in v.schema.names])
        known = old.select(key).join(F.broadcast(new.select(key)), key, "left_semi")
        fresh = new.join(F.broadcast(known), key, "left_anti")
        fresh = fresh.select(*[C(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in v.schema]).repartition(bucket_of(key, v.buckets))
        rows = changed.unionByName(fresh)
        if max((len(_names(spark, f"{path}/{v.folders[k]}")) for k in touched if k in v.folders), default=0) > MANY_FILES:
            rows = rows.repartition(len(touched), bucket_of(key, v.buckets))
    else:
        rows = upserted(old, new, [key], columns, gone).repartition(len(touched), bucket_of(key, v.buckets))
    written = _write(rows, path, v.number + 1, v.buckets, key)
    after = Version(v.number + 1, key, v.buckets, v.schema, {k: at for k, at in v.folders.items() if k not in touched} | written)
    _publish(spark, path, after)
    _clean(spark, path)
    return after
