"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Broadcast joins stay behind Spark's own size check
# (autoBroadcastJoinThreshold); AQE splits skewed join partitions beyond it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "etaforge", master: str | None = None, **extra: str) -> SparkSession:
    """Session with UTC time, ANSI mode and AQE on; `extra` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are compared as UTC wall time everywhere; make a foreign session agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, which the cluster names.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    root = tempfile.mkdtemp(prefix="etaforge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so retries cannot mix outputs."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_through(df, label: str, partition_by: tuple[str, ...] = ()):
    """Cut lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
