"""Parquet tables with a key: upsert, replace-by-partition, CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.operators.joins import latest_per_key
from etaforge.session import write_through

PREDICTION_KEY = ["order_id", "model_version"]
PREDICTION_ORDER = ["created_at", "seq"]
PREDICTION_PARTITIONS = ["prediction_period", "model_version"]


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both frames, the latest per key."""
    return latest_per_key(old.unionByName(new.select(*old.columns)), keys, order)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def upsert(
    updates: DataFrame,
    path: str,
    keys: list[str] = PREDICTION_KEY,
    order: list[str] = PREDICTION_ORDER,
    partitions: list[str] = PREDICTION_PARTITIONS,
) -> None:
    """Merge `updates` into the table at `path`; running it again changes nothing.

    A key must always fall into the same partition, as a prediction does: its period is that of
    the order's own creation. Only touched partitions are read, merged into a staging folder and
    swapped in by dynamic partition overwrite; the table never is source and target of one job,
    and a failure before the swap leaves it as it was.
    """
    spark = updates.sparkSession
    if path_exists(spark, path):
        new = write_through(updates, "upsert-new")
        old = spark.read.schema(new.schema).parquet(path).where(_touched(new, partitions))
        new = write_through(merge_latest(old, new, keys, order), "upsert-merged")
    else:
        new = latest_per_key(updates, keys, order)
    # Rows of one partition meet in few tasks, and AQE splits the partitions that are too large
    # for one: neither tiny files from every task nor one huge writer.
    replace_partitions(new.hint("rebalance", *partitions), path, partitions)


def _touched(new: DataFrame, partitions: list[str]) -> Column:
    """Literal filter on the table partitions `new` has rows for, so that the scan lists and reads
    only those. The driver sees one row per partition, as it does when it lists the table."""
    first, *rest = partitions
    groups: dict = {}
    for row in new.select(*partitions).distinct().collect():
        groups.setdefault(tuple(row[c] for c in rest), []).append(row[first])
    keep = F.lit(False)
    for others, firsts in groups.items():
        same = F.col(first).isin(firsts)
        for column, value in zip(rest, others, strict=True):
            same = same & (F.col(column) == F.lit(value))
        keep = keep | same
    return keep


def replace_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite exactly the partitions `df` holds rows for."""
    (
        df.write.partitionBy(*partitions)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder with header per table; names starting with `sqlite_` or `_` are system
    tables and left out. Timestamps keep their microseconds."""
    written = {}
    for name, df in tables.items():
        if name.startswith(("sqlite_", "_")):
            continue
        path = f"{folder}/{name}"
        (
            df.write.option("header", True)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            .csv(path)
        )
        written[name] = path
    return written


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .schema(schema)
        .csv(path)
    )
