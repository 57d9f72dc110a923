"""Feature assembly for training and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etaforge.functions.clock import day_of_week, hour_of_day, is_weekend
from etaforge.functions.geo import haversine_km
from etaforge.functions.guards import quantity_or_one
from etaforge.operators.joins import fanout_left_join
from etaforge.operators.pit import RollingAgg, rolling_features
from etaforge.sources.history import Span, delivered, visible_history
from etaforge.sources.tables import DeliveryTables


def order_quantities(order_items: DataFrame) -> DataFrame:
    """Summed quantity per order, combined map-side so that no order's items meet in one task."""
    return order_items.groupBy("order_id").agg(F.sum("quantity").alias("quantity"))


def with_quantity(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders with their summed quantity; 1 for orders without items."""
    joined = orders.join(order_quantities(order_items), "order_id", "left")
    return joined.withColumn("quantity", quantity_or_one(F.col("quantity")))


def with_items(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """One row per order item; orders without items stay with a NULL quantity."""
    return fanout_left_join(orders, order_items, "order_id")


def with_store_location(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Adds `latitude`, `longitude`. No broadcast hint: Spark broadcasts `stores` when its size
    allows and else shuffles, where AQE splits the partition of a hot store (left side)."""
    return orders.join(stores.select("store_id", "latitude", "longitude"), "store_id", "left")


def training_base(
    orders: DataFrame, start: str | None = None, end: str | None = None, ordered: bool = False
) -> DataFrame:
    """Delivered orders created in `[start, end)`; `ordered` sorts by creation time, for a sink."""
    base = delivered(orders)
    if start is not None:
        base = base.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        base = base.where(F.col("created_at") < F.lit(end).cast("timestamp"))
    return base.orderBy("created_at", "order_id") if ordered else base


def latest_creation(orders: DataFrame) -> str:
    """The newest creation time as text: the (exclusive) end of a default training range."""
    return orders.agg(F.max("created_at").cast("string")).first()[0]


def store_aggs(window_days: int = 30) -> list[RollingAgg]:
    return [
        RollingAgg(f"restaurant_avg_delivery_minutes_{window_days}d", "mean", window_days),
        RollingAgg(f"restaurant_order_count_{window_days}d", "count", window_days),
    ]


def customer_aggs(window_days: int = 30) -> list[RollingAgg]:
    return [
        RollingAgg(f"customer_order_count_{window_days}d", "count", window_days),
        RollingAgg(f"customer_avg_delivery_minutes_{window_days}d", "mean", window_days),
    ]


def with_store_history(
    targets: DataFrame,
    history: DataFrame,
    aggs: list[RollingAgg] | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    return rolling_features(
        targets, history, "store_id", "created_at", "delivered_at", "delivery_time_minutes",
        aggs or store_aggs(), moments,
    )


def with_customer_history(
    targets: DataFrame,
    history: DataFrame,
    aggs: list[RollingAgg] | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    return rolling_features(
        targets, history, "customer_id", "created_at", "delivered_at", "delivery_time_minutes",
        aggs or customer_aggs(), moments,
    )


def with_order_features(orders: DataFrame) -> DataFrame:
    """Distance and calendar features; needs both coordinate pairs and `created_at`."""
    at = F.col("created_at")
    return orders.withColumns(
        {
            "distance_km": haversine_km(
                F.col("latitude"),
                F.col("longitude"),
                F.col("delivery_latitude"),
                F.col("delivery_longitude"),
            ),
            "hour_of_day": hour_of_day(at),
            "day_of_week": day_of_week(at),
            "is_weekend": is_weekend(at),
        }
    )


def feature_columns(window_days: int = 30) -> list[str]:
    return [
        f"restaurant_avg_delivery_minutes_{window_days}d",
        f"restaurant_order_count_{window_days}d",
        f"customer_order_count_{window_days}d",
        f"customer_avg_delivery_minutes_{window_days}d",
        "distance_km",
        "hour_of_day",
        "day_of_week",
        "is_weekend",
        "total",
        "quantity",
    ]


def order_features(
    targets: DataFrame,
    tables: DeliveryTables,
    window_days: int = 30,
    history: DataFrame | None = None,
    span: Span = (None, None),
    period: str = "day",
) -> DataFrame:
    """Every feature for the given orders, as of each order's own `created_at`.

    With a stored `history` and the `span` of the targets (`span_of`) only the periods that their windows
    touch are read.
    """
    history = delivered(tables.orders) if history is None else history
    history = visible_history(history, span, window_days, period)
    out = with_store_history(targets, history, store_aggs(window_days))
    out = with_customer_history(out, history, customer_aggs(window_days))
    out = with_order_features(with_store_location(out, tables.stores))
    return with_quantity(out, tables.order_items)


def training_features(
    tables: DeliveryTables,
    start: str | None = None,
    end: str | None = None,
    window_days: int = 30,
    grain: str = "order",
    history: DataFrame | None = None,
    period: str = "day",
) -> DataFrame:
    """Training set. `grain="item"` repeats an order for each of its items.

    Item rows are joined last: features are computed once per order, not once per item. Of the
    history only `[start - window, end)` is read; one stored by `write_history` is pruned to the
    folders of those periods.
    """
    if grain not in ("order", "item"):
        raise ValueError("grain must be 'order' or 'item'")
    base = training_base(tables.orders, start, end).select(
        "order_id", "customer_id", "store_id", "created_at", "delivery_time_minutes",
        "delivery_latitude", "delivery_longitude", "total",
    )
    history = delivered(tables.orders) if history is None else history
    history = visible_history(history, (start, end), window_days, period)
    out = with_store_history(base, history, store_aggs(window_days))
    out = with_customer_history(out, history, customer_aggs(window_days))
    out = with_order_features(with_store_location(out, tables.stores))
    out = (with_quantity if grain == "order" else with_items)(out, tables.order_items)
    return out.select("order_id", "created_at", "delivery_time_minutes", *feature_columns(window_days))
