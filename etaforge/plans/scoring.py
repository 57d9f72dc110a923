"""Batch scoring of confirmed orders and the prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etaforge.functions.clock import parse_iso
from etaforge.functions.guards import request_quantity
from etaforge.functions.jsonmap import encode_features
from etaforge.operators.online import lookup
from etaforge.operators.validate import rejected_rows, valid_rows, with_reasons
from etaforge.plans.features import (
    customer_aggs,
    delivered,
    store_aggs,
    with_customer_history,
    with_order_features,
    with_quantity,
    with_store_history,
    with_store_location,
)
from etaforge.session import write_through
from etaforge.sources.history import Span, span_of, visible_history
from etaforge.sources.tables import DeliveryTables

STORE_FEATURES = ["restaurant_avg_delivery_minutes_30d", "restaurant_order_count_30d"]
CUSTOMER_FEATURES = ["customer_order_count_30d"]
MODEL_FEATURES = [
    *STORE_FEATURES, *CUSTOMER_FEATURES,
    "distance_km", "hour_of_day", "day_of_week", "is_weekend", "total", "quantity",
]


def pending_orders(orders: DataFrame) -> DataFrame:
    return orders.where(
        F.col("delivered_at").isNull()
        & F.col("created_at").isNotNull()
        & F.col("confirmed_at").isNotNull()
    )


def confirmed_orders(
    tables: DeliveryTables, limit: int | None = None, ordered: bool = False
) -> DataFrame:
    """Confirmed, undelivered orders of located stores with their quantity.

    With a limit: the newest orders. The limit applies before item quantities are joined.
    `ordered` sorts the result newest first, for a sink.
    """
    newest_first = (F.col("created_at").desc(), F.col("order_id"))
    located = with_store_location(pending_orders(tables.orders), tables.stores).where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    if limit:
        located = located.orderBy(*newest_first).limit(limit)
    out = with_quantity(located, tables.order_items).select(
        "order_id", "customer_id", "store_id", "created_at", "latitude", "longitude",
        "delivery_latitude", "delivery_longitude", "total", "quantity",
    )
    return out.orderBy(*newest_first) if ordered else out


def fill_from_history(requests: DataFrame, history: DataFrame, window_days: int = 30, period: str = "day") -> DataFrame:
    """The store and customer features that the online snapshot lacks, computed from deliveries
    before the order's creation; a group is taken as a whole when its first feature is NULL.

    The requests are stored first, as they are read once to find what is lacking. Of the history
    only the periods that windows of the lacking ones touch are read, of those only the lacking
    entities' rows are shuffled, and where nothing is lacking the history is not read at all.
    """
    requests = write_through(requests, "looked-up")
    groups = (
        ("store_id", STORE_FEATURES, with_store_history, store_aggs(window_days)),
        ("customer_id", CUSTOMER_FEATURES, with_customer_history, customer_aggs(window_days)[:1]),
    )
    for key, names, with_history, aggs in groups:
        lacking = requests.where(F.col(names[0]).isNull())
        span = span_of(lacking)
        if span[0] is None:
            continue
        moments = lacking.select(key, "created_at")
        seen = visible_history(history, span, window_days, period)
        own = seen.join(moments.select(key).distinct(), key, "left_semi")
        cached = requests.withColumnsRenamed({n: f"cached_{n}" for n in names})
        hit = F.col(f"cached_{names[0]}").isNotNull()
        requests = with_history(cached, own, aggs, moments)
        requests = requests.withColumns({n: F.when(hit, F.col(f"cached_{n}")).otherwise(F.col(n)) for n in names})
        requests = requests.drop(*(f"cached_{n}" for n in names))
    return requests


def inference_features(
    requests: DataFrame,
    history: DataFrame,
    online: DataFrame | None = None,
    now: Column | None = None,
    moments: DataFrame | None = None,
    span: Span = (None, None),
    period: str = "day",
) -> DataFrame:
    """Requests with all model features: cached entity values first, computed ones for the misses only.

    `moments`: a cheaper frame that holds the requests' keys and times, see `rolling_features`;
    `span`: the first and last of those times, to which the history is pruned. Both serve requests
    without an online snapshot.
    """
    if online is None:
        history = visible_history(history, span, 30, period)
        out = with_store_history(requests, history, store_aggs(), moments)
        out = with_customer_history(out, history, customer_aggs()[:1], moments)
        return with_order_features(out)
    out = lookup(requests, online, "restaurant", "store_id", STORE_FEATURES, now)
    out = lookup(out, online, "customer", "customer_id", CUSTOMER_FEATURES, now)
    return with_order_features(fill_from_history(out, history, period=period))


def rule_minutes(
    average: str = STORE_FEATURES[0], count: str = STORE_FEATURES[1], distance: str = "distance_km"
) -> Column:
    """A fixed rule in place of a trained model: store average (45 without history) plus
    1.5 minutes per km. It makes scoring comparable across engines."""
    base = F.when(F.col(count) > 0, F.col(average)).otherwise(45.0)
    return base + 1.5 * F.coalesce(F.col(distance), F.lit(0.0))


def rule_scores(features: DataFrame, version: str = "rule-1", shift: float = 0.0) -> DataFrame:
    return features.withColumns(
        {
            "predicted_delivery_minutes": rule_minutes() + shift,
            "model_version": F.lit(version),
        }
    )


def as_predictions(
    scored: DataFrame, created_at: Column | None = None, seq: int = 0, period: str = "day"
) -> DataFrame:
    """Rows of the prediction table. The prediction time is the order's own creation time, so
    an order always falls into the same partition; `prediction_id` is a hash of the unique key.
    `period` (day, week, month, year) sizes the partitions: an upsert rewrites the ones it touches."""
    made = F.current_timestamp() if created_at is None else created_at
    return scored.select(
        F.xxhash64("order_id", "model_version").alias("prediction_id"),
        "order_id",
        "customer_id",
        "store_id",
        "predicted_delivery_minutes",
        F.col("created_at").alias("prediction_timestamp"),
        "model_version",
        encode_features(MODEL_FEATURES).alias("features_json"),
        made.alias("created_at"),
        F.lit(seq).cast("long").alias("seq"),
        F.to_date(F.date_trunc(period, "created_at")).alias("prediction_period"),
    )


def scoring_rules() -> dict[str, Column]:
    """Reasons to keep an order out of scoring; a broken order never stops the batch."""
    return {
        "no order id": F.col("order_id").isNull(),
        "no store": F.col("store_id").isNull(),
        "no creation time": F.col("created_at").isNull(),
        "no coordinates": F.col("latitude").isNull()
        | F.col("longitude").isNull()
        | F.col("delivery_latitude").isNull()
        | F.col("delivery_longitude").isNull(),
        "negative total": F.col("total").isNull() | (F.col("total") < 0),
    }


def score_batch(
    tables: DeliveryTables,
    score,
    limit: int | None = None,
    online: DataFrame | None = None,
    now: Column | None = None,
    created_at: Column | None = None,
    period: str = "day",
    history: DataFrame | None = None,
    history_period: str = "day",
) -> tuple[DataFrame, DataFrame]:
    """`(predictions, rejects)` for confirmed orders; `score` maps a feature frame to a scored one.

    `history` may be a stored one, of which the periods that the pending orders see are read.
    """
    checked = with_reasons(confirmed_orders(tables, limit), scoring_rules())
    # With a limit the few orders themselves are the cheaper source of moments.
    pending = pending_orders(tables.orders)
    span = span_of(pending) if online is None else (None, None)
    history = delivered(tables.orders) if history is None else history
    features = inference_features(
        valid_rows(checked), history, online, now, None if limit else pending, span, history_period
    )
    return as_predictions(score(features), created_at, period=period), rejected_rows(checked)


REQUEST_ORDERS = (
    "array<struct<order_id:bigint,customer_id:bigint,store_id:bigint,latitude:double,"
    "longitude:double,delivery_latitude:double,delivery_longitude:double,total:bigint,"
    "quantity:bigint,created_at:string>>"
)


def explode_requests(requests: DataFrame, batch: str = "request_id") -> DataFrame:
    """One row per order of each batch request, its creation time parsed and its quantity filled."""
    return (
        requests.select(batch, F.inline("orders"))
        .withColumnRenamed("created_at", "created_at_text")
        .withColumns(
            {
                "created_at": parse_iso(F.col("created_at_text")),
                "quantity": request_quantity(F.col("quantity")),
            }
        )
    )


def prediction_stats(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.countDistinct("order_id").alias("unique_orders"),
        F.avg("predicted_delivery_minutes").alias("avg_prediction_minutes"),
        F.min("predicted_delivery_minutes").alias("min_prediction_minutes"),
        F.max("predicted_delivery_minutes").alias("max_prediction_minutes"),
        F.min("prediction_timestamp").alias("earliest_prediction"),
        F.max("prediction_timestamp").alias("latest_prediction"),
    )


def recent_predictions(predictions: DataFrame, limit: int = 100) -> DataFrame:
    """The most recently stored predictions; ties by insert sequence, then key."""
    return (
        predictions.orderBy(
            F.col("created_at").desc(), F.col("seq").desc(), "order_id", "model_version"
        )
        .limit(limit)
        .select(
            "order_id", "customer_id", "store_id", "predicted_delivery_minutes",
            "prediction_timestamp", "model_version", "created_at",
        )
    )
