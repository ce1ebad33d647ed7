"""Session factory and the shared-folder rule for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "modiste", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MODISTE_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's `spark.checkpoint.dir`, else a folder of our own (local runs)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="modiste-ckpt-")
            at = spark._jvm.org.apache.hadoop.fs.Path(configured)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # a local run's folder goes with its session
        sc.setCheckpointDir(configured)
    return configured or current


def cut(df):
    """Materialise `df` on reliable storage and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
