"""Plan properties that decide whether a job survives large and skewed data."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from etaforge.plans import materialize, scoring
from etaforge.plans.features import (
    delivered,
    store_aggs,
    training_features,
    with_store_history,
    with_store_location,
)
from etaforge.operators.pit import _partials, _seconds_with_probes
from etaforge.operators.ranks import exact_quantiles
from etaforge.session import scratch_dir
from etaforge.sources import keyed
from etaforge.sources.tables import DeliveryTables


@pytest.fixture(scope="module")
def root(spark):
    """Delivery tables with 30,000 orders; a third of them belong to store 1."""
    home = scratch_dir(spark, "t-scale")
    spark.range(30_000).selectExpr(
        "id as order_id",
        "id % 700 as customer_id",
        "case when id % 3 = 0 then 1 when id % 101 = 0 then null else id % 300 end as store_id",
        "id % 9000 as total",
        "timestamp_micros(1704067200000000 + (id * 7919 % 30000) * 172800000) as created_at",
        "timestamp_micros(1704067200000000 + (id * 7919 % 30000) * 172800000 + 60000000) as confirmed_at",
        "case when id % 5 <> 0 then timestamp_micros(1704067200000000 + (id * 7919 % 30000) * 172800000"
        " + 600000000 + (id * 31 % 4800) * 1000000) end as delivered_at",
        "47.0D + id % 100 / 200.0D as delivery_latitude",
        "-122.0D - id % 90 / 200.0D as delivery_longitude",
    ).write.parquet(f"{home}/orders")
    spark.range(300).selectExpr("id as store_id", "47.1D as latitude", "-122.1D as longitude").write.parquet(
        f"{home}/stores"
    )
    spark.range(60_000).selectExpr("id % 30000 as order_id", "id % 7 + 1 as quantity").write.parquet(
        f"{home}/order_items"
    )
    return home


@pytest.fixture()
def conf(spark):
    """Set session values for one test."""
    before = {}

    def set_all(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            before[key] = spark.conf.get(key)
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_filters(df):
    """The formatted plan, which does not shorten pushed filters."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_span_windows_equal_range_frames(spark, root):
    """The same averages as one RANGE frame per store, which is the plan that does not scale."""
    orders = DeliveryTables.from_parquet(spark, root).orders
    history = delivered(orders)
    got = with_store_history(orders.select("order_id", "store_id", "created_at"), history)

    micros = 1_000_000
    events = history.where("store_id is not null").select(
        "store_id", F.unix_micros("delivered_at").alias("t"), F.lit(1).alias("hit"),
        F.col("delivery_time_minutes").alias("v"), F.lit(None).cast("bigint").alias("order_id"),
    )
    asked = orders.where("store_id is not null").select(
        "store_id", (F.unix_seconds("created_at") * micros).alias("t"), F.lit(0).alias("hit"),
        F.lit(None).cast("double").alias("v"), "order_id",
    )
    frame = Window.partitionBy("store_id").orderBy("t").rangeBetween(-30 * 86_400 * micros, -1)
    want = (
        events.unionByName(asked)
        .select("order_id", "hit", F.sum("hit").over(frame).alias("n"), F.avg("v").over(frame).alias("a"))
        .where("hit = 0")
    )
    names = [a.name for a in store_aggs()]
    off = got.join(want, "order_id", "left").where(
        (F.col(names[1]) != F.coalesce("n", F.lit(0)))
        | (F.abs(F.col(names[0]) - F.coalesce("a", F.lit(0.0))) > 1e-9)
    )
    assert got.count() == 30_000
    assert off.count() == 0


def test_hot_store_shrinks_before_the_shuffle(spark, root):
    """Rows per (store, span) are bounded by the seconds of the window, not by the orders."""
    orders = DeliveryTables.from_parquet(spark, root).orders
    copies = orders.withColumn("created_at", F.lit("2024-01-10 00:00:00").cast("timestamp")).withColumn(
        "delivered_at", F.lit("2024-01-05 00:00:00.5").cast("timestamp")
    )
    seconds = _seconds_with_probes(
        copies, delivered(copies), "store_id", "created_at", "delivered_at", "delivery_time_minutes",
        [30], _partials(store_aggs()),
    )
    assert seconds.where("k = 1").count() == 3  # one history second and two window bounds


def test_filters_and_columns_reach_the_scan(spark, root):
    orders = DeliveryTables.from_parquet(spark, root).orders
    snapshot = materialize.entity_snapshot(orders, "store_id", "2024-02-01 00:00:00")
    shown, plan_text = plan(snapshot), scan_filters(snapshot)
    assert "GreaterThanOrEqual(delivered_at,2024-01-02" in plan_text
    assert "LessThan(delivered_at" in plan_text
    assert "ReadSchema: struct<store_id:bigint,created_at:timestamp,delivered_at:timestamp>" in shown
    training = training_features(DeliveryTables.from_parquet(spark, root), "2024-02-01 00:00:00")
    assert "GreaterThanOrEqual(created_at,2024-02-01" in scan_filters(training)
    assert "confirmed_at" not in plan(training)


def test_snapshot_reads_prune_partitions(spark, root):
    orders = DeliveryTables.from_parquet(spark, root).orders
    path = scratch_dir(spark, "t-prune")
    for day in ("2024-01-20 00:00:00", "2024-02-20 00:00:00"):
        table = materialize.materialize(orders, "store_id", day, path)
    shown = plan(materialize.entity_count(table, "store_id", "2024-02-20 00:00:00"))
    filters = shown.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "computed_at" in filters


def test_hot_store_is_split_in_the_location_join(spark, root, conf):
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="16KB",
    )
    tables = DeliveryTables.from_parquet(spark, root)
    spread = tables.orders.repartition(16)  # several map tasks, so that a partition can be split
    joined = with_store_location(spread, tables.stores)
    assert len(joined.collect()) == 30_000
    assert "skew=true" in plan(joined) or "isSkew" in plan(joined) or "skewed" in plan(joined)


def test_limit_comes_before_features(spark, root):
    tables = DeliveryTables.from_parquet(spark, root)
    shown = plan(scoring.confirmed_orders(tables, limit=10))
    assert "TakeOrderedAndProject" in shown


def test_upsert_leaves_other_partitions_alone(spark, root):
    path = scratch_dir(spark, "t-upsert-files")
    rows = spark.range(100).selectExpr(
        "id as order_id", "'v' as model_version", "1.0D as predicted",
        "timestamp'2024-01-01' as created_at", "0L as seq",
        "date_add(date'2024-01-01', cast(id % 4 as int)) as prediction_period",
    )
    keyed.upsert(rows, path)

    def files():
        return {
            folder.rsplit("=", 2)[1]: sorted(f for f in names if f.endswith(".parquet"))
            for folder, _, names in os.walk(path.removeprefix("file:"))
            if "model_version=" in folder
        }

    before = files()
    keyed.upsert(rows.where("order_id % 4 = 2").withColumn("seq", F.lit(1).cast("long")), path)
    after = files()
    changed = [day for day in before if before[day] != after[day]]
    assert len(before) == 4 and changed == ["2024-01-03/model_version"]
    assert spark.read.parquet(path).count() == 100


def test_quantiles_never_gather_a_column(spark, root):
    orders = DeliveryTables.from_parquet(spark, root).orders
    shown = plan(exact_quantiles(orders, ["total", "delivery_latitude"], [0.5])).lower()
    assert "percentile" not in shown and "collect_list" not in shown
    assert "rangepartitioning" not in shown
