"""Entity features from day tiles: a day's deliveries are aggregated once, a snapshot merges days."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.session import pin_utc
from etaforge.sources.history import as_moment, visible_history
from etaforge.sources.keyed import replace_partitions

#: A tile: rows, rows with minutes and their sum per entity and day of delivery.
TILE = "n bigint, nv bigint, minutes double, day date"
#: Sketches of the stores and customers that were active on a day.
ACTIVITY = "stores binary, customers binary, day date"
#: log2 of the sketch size; the relative standard error is 1.04 / sqrt(2^12) = 1.6 %.
SKETCH_K = 12


def _day(at: str | date) -> date:
    return at if isinstance(at, date) and not isinstance(at, datetime) else as_moment(at).date()


def _deliveries_of(history: DataFrame, first: date, last: date, period: str) -> DataFrame:
    """Deliveries of the days first..last, read with literal bounds."""
    span = (datetime.combine(first, datetime.min.time()), datetime.combine(last + timedelta(days=1), datetime.min.time()))
    return visible_history(history, span, 0, period).withColumn("day", F.to_date("delivered_at"))


def _partials(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("delivery_time_minutes").alias("nv"),
        F.sum("delivery_time_minutes").alias("minutes"),
    )


def refresh_tiles(
    history: DataFrame, key: str, first: str | date, last: str | date, path: str, period: str = "day"
) -> None:
    """Write the tiles of the days first..last, replacing those days and no others.

    The daily job names one day and reads that day of the history only; a day with late deliveries
    is refreshed by naming it again.
    """
    rows = _deliveries_of(history, _day(first), _day(last), period).where(F.col(key).isNotNull())
    replace_partitions(_partials(rows, key, "day").hint("rebalance", "day"), path, ["day"])


def read_tiles(spark: SparkSession, path: str, key: str, key_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"{key} {key_type}, {TILE}").parquet(path)


def snapshot_from_tiles(
    tiles: DataFrame, history: DataFrame, key: str, as_of: str, window_days: int = 30, period: str = "day"
) -> DataFrame:
    """Average minutes and row count per entity over `[as_of - window, as_of)`, as `entity_snapshot`.

    Whole days come from their tiles (selected by partition), the two cut days at the window's
    ends from the history (none at midnight). An entity's rows are a tile per day at the most, so no
    entity is hot.
    """
    pin_utc(tiles.sparkSession)
    end = as_moment(as_of).replace(microsecond=0)
    start = end - timedelta(days=window_days)
    midnight = datetime.min.time()
    first = start.date() if start.time() == midnight else start.date() + timedelta(days=1)
    last = end.date() - timedelta(days=1)
    whole = tiles.where(F.col("day").between(F.lit(first), F.lit(last))).drop("day")
    cuts = [
        span
        for span in ((start, datetime.combine(first, midnight)), (datetime.combine(end.date(), midnight), end))
        if span[0] < span[1]
    ]
    for span in cuts:
        edge = visible_history(history, span, 0, period).where(F.col(key).isNotNull())
        whole = whole.unionByName(_partials(edge, key))
    merged = whole.groupBy(key).agg(F.sum("n").alias("order_count"), F.sum("nv").alias("nv"), F.sum("minutes").alias("minutes"))
    return merged.select(
        key,
        F.try_divide("minutes", "nv").alias("avg_delivery_minutes"),
        "order_count",
        F.lit(as_of).cast("timestamp").alias("computed_at"),
        F.lit(window_days).alias("window_days"),
    )


def refresh_activity(history: DataFrame, first: str | date, last: str | date, path: str, period: str = "day") -> None:
    """Write, for the days first..last, a sketch of the active stores and one of the active customers."""
    rows = _deliveries_of(history, _day(first), _day(last), period)
    sketches = rows.groupBy("day").agg(
        F.hll_sketch_agg("store_id", SKETCH_K).alias("stores"), F.hll_sketch_agg("customer_id", SKETCH_K).alias("customers")
    )
    replace_partitions(sketches, path, ["day"])


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY).parquet(path)


def active_entities(activity: DataFrame, ends: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Approximate numbers of different stores and customers in the `window_days` days before each
    day in `ends`, from the stored sketches alone: one of a day serves every window that holds it."""
    asked = [(_day(end), days) for end in ends for days in windows]
    first, last = min(end - timedelta(days=days) for end, days in asked), max(end for end, _ in asked)
    inside = F.array(
        *(
            F.when(
                (F.col("day") < F.lit(end)) & (F.col("day") >= F.lit(end - timedelta(days=days))),
                F.struct(F.lit(end).alias("as_of_day"), F.lit(days).alias("window_days")),
            )
            for end, days in asked
        )
    )
    days = activity.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(last)))
    held = days.select(F.inline(F.array_compact(inside)), "stores", "customers")
    return held.groupBy("as_of_day", "window_days").agg(
        F.hll_sketch_estimate(F.hll_union_agg("stores")).alias("stores"),
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers"),
    )
