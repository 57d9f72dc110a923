"""Delivery tables derived from a commerce star schema (orders, lineitem, supplier).

That schema has no coordinates and no delivery times, so both come from the keys by the fixed
formulas below; they are the same for every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.functions.clock import add_seconds
from etaforge.sources.tables import EVENTS, DeliveryTables, scan

RAW_ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string"
)
RAW_LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
)
RAW_SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int"


def tables(spark: SparkSession, root: str) -> DeliveryTables:
    return DeliveryTables(orders(spark, root), stores(spark, root), order_items(spark, root))


def orders(spark: SparkSession, root: str, with_store: bool = True) -> DataFrame:
    """Orders; `with_store=False` leaves out `store_id` and with it the line-item shuffle."""
    raw = scan(spark, f"{root}/orders.parquet", RAW_ORDERS)
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    placed_second = (key * 7919) % 86_400

    def after(extra: Column) -> Column:
        return add_seconds(F.col("o_orderdate"), placed_second + extra)

    columns = {
        "order_id": key,
        "customer_id": customer,
        "total": F.floor("o_totalprice").cast("long"),
        "created_at": after(F.lit(0)),
        "confirmed_at": F.when(F.col("o_orderstatus") != "P", after(60 + key % 240)),
        "delivered_at": F.when(
            F.col("o_orderstatus") == "F", after(600 + (key * 31 + customer * 17) % 4800)
        ),
        "delivery_latitude": 47.0 + ((key * 31 + customer) % 10_000) / F.lit(2e4),
        "delivery_longitude": -122.0 - ((key * 17 + customer * 3) % 10_000) / F.lit(2e4),
    }
    derived = raw.select(*(expr.alias(name) for name, expr in columns.items()))
    if not with_store:
        return derived
    first_store = (
        scan(spark, f"{root}/lineitem.parquet", RAW_LINEITEM)
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.min("l_suppkey").alias("store_id"))
    )
    return derived.join(first_store, "order_id", "left")


def stores(spark: SparkSession, root: str) -> DataFrame:
    raw = scan(spark, f"{root}/supplier.parquet", RAW_SUPPLIER)
    key = F.col("s_suppkey")
    located = key % 17 != 5
    return raw.select(
        key.alias("store_id"),
        F.when(located, 47.0 + ((key * 7919) % 10_000) / F.lit(2e4)).alias("latitude"),
        F.when(located, -122.0 - ((key * 104_729) % 10_000) / F.lit(2e4)).alias("longitude"),
    )


def order_items(spark: SparkSession, root: str) -> DataFrame:
    raw = scan(spark, f"{root}/lineitem.parquet", RAW_LINEITEM)
    return raw.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("quantity")
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, f"{root}/events.parquet", EVENTS)


def request_log(spark: SparkSession, root: str) -> DataFrame:
    """Scoring request log made from `events`: an `error` event is a failed request."""
    failed = F.col("event_type") == "error"
    return events(spark, root).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id").alias("order_id"),
        F.when(~failed, 10.0 + (F.col("event_id") * 37) % 80).alias("prediction"),
        F.when(failed, F.concat(F.lit("failed: "), F.col("props"))).alias("error"),
        F.col("value").alias("latency_ms"),
    )


def lifecycle_events(source: DataFrame) -> DataFrame:
    """One row per lifecycle step of each order: placed, assigned, delivered or cancelled."""
    def step(name: str, at: Column) -> Column:
        return F.struct(F.lit(name).alias("event_type"), at.alias("event_at"))

    pending = F.col("confirmed_at").isNull()
    steps = F.array(
        step("placed", F.col("created_at")),
        step("assigned", F.col("confirmed_at")),
        step("picked_up", F.when(F.col("delivered_at").isNotNull(),
                                 add_seconds(F.col("confirmed_at"), F.lit(120)))),
        step("delivered", F.col("delivered_at")),
        step("cancelled", F.when(pending & (F.col("order_id") % 7 == 0),
                                 add_seconds(F.col("created_at"), F.lit(900)))),
    )
    kept = F.filter(steps, lambda s: s["event_at"].isNotNull())
    return source.select(
        "order_id",
        "customer_id",
        "total",
        F.when(F.col("confirmed_at").isNotNull(), F.col("order_id") % 50).alias("driver_id"),
        F.inline(kept),
    )
