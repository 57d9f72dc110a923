"""Materialized entity snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.operators.pit import grouped_window_stats
from etaforge.plans.features import delivered
from etaforge.sources.keyed import replace_partitions

SNAPSHOT_PARTITIONS = ["computed_at", "window_days"]


def entity_snapshot(orders: DataFrame, key: str, as_of: str, window_days: int = 30) -> DataFrame:
    """Average delivery minutes and order count per entity over the window before `as_of`."""
    moment = F.lit(as_of).cast("timestamp")
    stats = grouped_window_stats(
        delivered(orders), key, moment, "delivered_at", "delivery_time_minutes", window_days
    )
    return stats.select(
        key,
        "avg_delivery_minutes",
        "order_count",
        F.lit(as_of).alias("computed_at"),
        F.lit(window_days).alias("window_days"),
    )


def materialize(
    orders: DataFrame, key: str, as_of: str, path: str, window_days: int = 30
) -> DataFrame:
    """Write the snapshot, replacing the same (as_of, window), and return the stored rows."""
    snapshot = entity_snapshot(orders, key, as_of, window_days)
    replace_partitions(snapshot, path, SNAPSHOT_PARTITIONS)
    return read_snapshots(orders.sparkSession, path, key, orders.schema[key].dataType.simpleString())


def read_snapshots(spark: SparkSession, path: str, key: str, key_type: str = "bigint") -> DataFrame:
    ddl = (
        f"{key} {key_type}, avg_delivery_minutes double, order_count bigint, "
        "computed_at string, window_days int"
    )
    rows = spark.read.schema(ddl).parquet(path)
    return rows.withColumn("computed_at", F.col("computed_at").cast("timestamp"))


def entity_count(snapshots: DataFrame, key: str, as_of: str, approximate: bool = False) -> DataFrame:
    """Distinct entities of one snapshot time, over all its windows."""
    rows = snapshots.where(F.col("computed_at") == F.lit(as_of).cast("timestamp"))
    count = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    return rows.agg(count.alias("entities"))
