"""Delivered orders stored by delivery period, and the part of them that a set of targets can see."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.functions.clock import elapsed_minutes

#: The partition column: first day of the period of `delivered_at`.
PERIOD_COLUMN = "delivered_period"
HISTORY = (
    "order_id bigint, store_id bigint, customer_id bigint, created_at timestamp, "
    f"delivered_at timestamp, delivery_time_minutes double, {PERIOD_COLUMN} date"
)

Span = tuple[datetime | None, datetime | None]


def delivered(orders: DataFrame) -> DataFrame:
    """Delivered orders with their delivery minutes: the history of every aggregate."""
    return orders.where(F.col("delivered_at").isNotNull()).withColumn(
        "delivery_time_minutes", elapsed_minutes(F.col("created_at"), F.col("delivered_at"))
    )


def period_of(period: str, at: Column) -> Column:
    return F.to_date(F.date_trunc(period, at))


def write_history(orders: DataFrame, path: str, period: str = "day", splits: int = 8) -> None:
    """Store the delivered orders of `orders`, one folder per period (day, week, month, year).

    Periods that `orders` covers are replaced, the others stay, so a daily load gives the orders
    delivered that day and the load may be repeated. Rows are dealt by period and one of `splits`
    hash parts of the order, so no task opens every folder and a large period has several tasks.
    """
    names = [c.split()[0] for c in HISTORY.split(", ")]
    rows = delivered(orders).withColumn(PERIOD_COLUMN, period_of(period, F.col("delivered_at"))).select(*names)
    dealt = rows.repartition(PERIOD_COLUMN, F.pmod(F.xxhash64("order_id"), F.lit(splits)))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PERIOD_COLUMN).parquet(path)


def read_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def span_of(targets: DataFrame, as_of: str = "created_at") -> Span:
    """First and last moment of the targets: one aggregate that reads that column. (None, None)
    without any."""
    row = targets.agg(F.min(as_of).cast("timestamp_ntz"), F.max(as_of).cast("timestamp_ntz")).first()
    return row[0], row[1]


def as_moment(at: datetime | str | None) -> datetime | None:
    return datetime.fromisoformat(at) if isinstance(at, str) else at


def visible_history(
    history: DataFrame, span: Span, window_days: int, period: str = "day", event_time: str = "delivered_at"
) -> DataFrame:
    """The rows that windows of `window_days` days can hold for targets within `span` (UTC moments;
    an open side is None).

    Both bounds are literals: on the event time they reach the Parquet scan as pushed filters, and
    on the period column of a stored history they select folders. `period` must be the one the
    history was written with, or a longer one.
    """
    first, last = map(as_moment, span)
    stored = PERIOD_COLUMN in history.columns

    def literal(at: datetime) -> Column:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp")

    at = F.col(event_time)
    if first is not None:
        low = first.replace(microsecond=0) - timedelta(days=window_days)
        history = history.where(at >= literal(low))
        if stored:
            history = history.where(F.col(PERIOD_COLUMN) >= period_of(period, literal(low)))
    if last is not None:
        history = history.where(at < literal(last))
        if stored:
            history = history.where(F.col(PERIOD_COLUMN) <= period_of(period, literal(last)))
    return history
