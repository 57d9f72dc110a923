"""The stream jobs. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from etaforge.functions.buckets import bucket_value, log_bucket
from etaforge.functions.clock import SECONDS_PER_DAY
from etaforge.operators.online import by_entity, lookup_entities
from etaforge.operators.validate import rejected_rows, valid_rows, with_reasons
from etaforge.plans.features import with_order_features
from etaforge.plans.scoring import (
    CUSTOMER_FEATURES,
    STORE_FEATURES,
    as_predictions,
    fill_from_history,
    scoring_rules,
)
from etaforge.session import write_through
from etaforge.sources.keyed import path_exists, upsert
from etaforge.streaming.late import read_late, run_with_late
from etaforge.streaming.sinks import drain, read_batches, read_latest, run_batches, store_batch

DEFAULT_DELAY = "1 hour"
DEDUP_GROUPS = 64


# --- scoring ---------------------------------------------------------------------------------


def score_requests(
    requests: DataFrame,
    stores: DataFrame,
    customers: DataFrame,
    score,
    now,
    created_at=None,
    period: str = "day",
    seq: int = 0,
    history: DataFrame | None = None,
    history_period: str = "day",
) -> tuple[DataFrame, DataFrame]:
    """Parsed orders to `(predictions, rejects)` with features of the online snapshot, given as
    `by_entity` tables. Those of an entity without live features are computed from `history`
    (delivered orders, of which only the time that these orders' windows cover is read); without one
    it counts as an entity without history. Of predictions with one `created_at` that of the
    greatest `seq` is the latest.
    """
    checked = with_reasons(requests, scoring_rules())
    good = lookup_entities(valid_rows(checked), stores, "store_id", STORE_FEATURES, now)
    good = lookup_entities(good, customers, "customer_id", CUSTOMER_FEATURES, now)
    if history is not None:
        good = fill_from_history(good, history, period=history_period)
    good = good.fillna(0.0, [*STORE_FEATURES, *CUSTOMER_FEATURES])
    scored = score(with_order_features(good))
    return as_predictions(scored, created_at, seq, period), rejected_rows(checked)


def stream_scoring(
    requests: DataFrame,
    online: DataFrame,
    score,
    predictions_path: str,
    rejects_path: str,
    checkpoint: str,
    now,
    created_at=None,
    period: str = "day",
    history: DataFrame | None = None,
    history_period: str = "day",
) -> StreamingQuery:
    """Score a stream of orders into the prediction table; rejects are kept with their reasons.

    The online rows are turned to one row per entity once, when the job starts; `history` serves
    the entities without a live row. A batch reads the part from its first order's window on to
    its last order: literal bounds, and folders of a stored history (`write_history`).
    """
    stores = write_through(by_entity(online, "restaurant", STORE_FEATURES), "online-stores")
    customers = write_through(by_entity(online, "customer", CUSTOMER_FEATURES), "online-customers")

    def handle(batch: DataFrame, batch_id: int) -> None:
        predictions, rejects = score_requests(
            batch, stores, customers, score, now, created_at, period, batch_id, history, history_period
        )
        upsert(predictions, predictions_path)
        store_batch(rejects, batch_id, rejects_path)

    return run_batches(requests, handle, checkpoint)


# --- order lifecycle -------------------------------------------------------------------------

STEPS = ("placed", "assigned", "picked_up", "delivered", "cancelled")  # fixed values
LIFECYCLE = "order_id bigint, customer_id bigint, total bigint, driver_id bigint, " + ", ".join(
    f"{step}_at timestamp" for step in STEPS
)


def lifecycle_of_events(events: DataFrame) -> DataFrame:
    """One row per order from its events: first time of each step, payload of the first event
    that carries it."""
    at, kind = F.col("event_at"), F.col("event_type")
    payload = {"customer_id": "placed", "total": "placed", "driver_id": "assigned"}
    return events.groupBy("order_id").agg(
        *(
            F.min_by(column, F.when(kind == step, at)).alias(column)
            for column, step in payload.items()
        ),
        *(F.min(F.when(kind == step, at)).alias(f"{step}_at") for step in STEPS),
    )


def merge_lifecycles(partial: DataFrame) -> DataFrame:
    """Partial lifecycle rows of one order into one row. Merging is associative, so batches need
    no state between them and a late event is never lost."""
    return partial.groupBy("order_id").agg(
        F.min_by("customer_id", "placed_at").alias("customer_id"),
        F.min_by("total", "placed_at").alias("total"),
        F.min_by("driver_id", "assigned_at").alias("driver_id"),
        *(F.min(f"{step}_at").alias(f"{step}_at") for step in STEPS),
    )


def stream_lifecycle(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each batch of events and store the partial rows. The order table is
    `merge_lifecycles` over them: no state store that would keep every order for ever."""
    return run_batches(
        events, lambda batch, batch_id: store_batch(lifecycle_of_events(batch), batch_id, path), checkpoint
    )


def read_lifecycles(spark: SparkSession, path: str) -> DataFrame:
    return merge_lifecycles(read_batches(spark, path, LIFECYCLE))


def compact_lifecycles(spark: SparkSession, path: str, target: str) -> None:
    """Merge all stored partial rows into one row per order under `target`, to which a stream
    with a new checkpoint can go on adding batches."""
    store_batch(read_lifecycles(spark, path), -1, target)


# --- rolling store metrics -------------------------------------------------------------------

STORE_DAYS = "store_id bigint, day timestamp, n bigint, minutes double"


def store_days(delivered: DataFrame) -> DataFrame:
    """Delivered orders and their minutes per store and day."""
    return (
        delivered.groupBy("store_id", F.window("delivered_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_time_minutes").alias("minutes"))
        .select("store_id", F.col("w.start").alias("day"), "n", "minutes")
    )


def sliding_windows(days: DataFrame, window_days: int = 30) -> DataFrame:
    """Sliding windows of `window_days`, one per day, from day totals.

    Equal to `window(ts, '30 days', '1 day')`, but the stream keeps one state row per store and
    day instead of `window_days` of them.
    """
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(window_days - 1)),
        lambda back: F.timestamp_seconds(F.unix_seconds("day") - back * SECONDS_PER_DAY),
    )
    return (
        days.withColumn("window_start", F.explode(starts))
        .groupBy("store_id", "window_start")
        .agg(F.sum("n").alias("n"), (F.sum("minutes") / F.sum("n")).alias("avg_minutes"))
    )


def stream_store_days(
    delivered: DataFrame, path: str, checkpoint: str, delay: str = DEFAULT_DELAY
) -> StreamingQuery:
    days = store_days(delivered.withWatermark("delivered_at", delay))
    return run_batches(
        days, lambda rows, batch_id: store_batch(rows, batch_id, path), checkpoint, "update"
    )


def stream_store_days_with_late(
    delivered: DataFrame, path: str, checkpoint: str, delay: str = DEFAULT_DELAY
) -> StreamingQuery:
    """Day totals of the rows in time, one partial row per store, day and batch; rows behind the
    watermark are kept in a side table and counted in the ledger, see `run_with_late`."""
    return run_with_late(
        delivered, "delivered_at",
        lambda rows, batch_id: store_batch(store_days(rows), batch_id, f"{path}/days"), path, checkpoint, delay,
    )


def read_store_days_with_late(spark: SparkSession, path: str, schema: str, merge_late: bool = True) -> DataFrame:
    """Day totals of all batches, with the late rows merged in or left out."""
    days = read_batches(spark, f"{path}/days", STORE_DAYS).drop("batch_id")
    if merge_late:
        days = days.unionByName(store_days(read_late(spark, path, schema)))
    return days.groupBy("store_id", "day").agg(F.sum("n").alias("n"), F.sum("minutes").alias("minutes"))


def read_store_days(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, STORE_DAYS, ["store_id", "day"])


# --- request monitoring ----------------------------------------------------------------------

REQUEST_BUCKETS = "window_start timestamp, bucket int, n bigint, failed bigint, latency_ms double"


def request_buckets(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests per tumbling window and latency bucket; failed ones have no bucket.

    Such counts are a quantile sketch that merges by addition. A window has some hundred buckets
    however many requests it sees, and its rows are combined map-side.
    """
    ok = F.col("prediction").isNotNull()
    bucket = F.when(ok, log_bucket(F.col("latency_ms"))).alias("bucket")
    return (
        log.groupBy(F.window("ts", width).alias("w"), bucket)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~ok).alias("failed"),
            F.sum(F.when(ok, F.col("latency_ms"))).alias("latency_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "bucket", "n", "failed", "latency_ms")
    )


def request_windows(buckets: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Counts, mean and percentiles of the latencies of successful requests per window.

    A percentile stands for the value at 0-based position floor(n * share) of the sorted
    latencies and differs from it by 1 % at most.
    """
    rising = Window.partitionBy("window_start").orderBy("bucket")
    until = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    known = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n"))).over(Window.partitionBy("window_start"))
    placed = buckets.withColumns({"until": until, "known": known})
    ranks = {f"p{round(share * 100)}": share for share in shares}
    totals = placed.groupBy("window_start").agg(
        F.sum("n").alias("total_requests"),
        F.sum(F.col("n") - F.col("failed")).alias("successful_requests"),
        F.sum("failed").alias("error_requests"),
        F.try_divide(F.sum("latency_ms"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")))).alias("avg_latency_ms"),
        *(
            F.min(F.when(F.col("bucket").isNotNull() & (F.col("until") > F.floor(F.col("known") * F.lit(share))), F.col("bucket"))).alias(name)
            for name, share in ranks.items()
        ),
    )
    return totals.withColumns({f"{name}_latency_ms": bucket_value(F.col(name)) for name in ranks}).drop(*ranks)


def stream_request_windows(
    log: DataFrame, path: str, checkpoint: str, delay: str = DEFAULT_DELAY
) -> StreamingQuery:
    """Keep the counts per window and latency bucket as stream state; each batch stores the changed
    ones."""
    return run_batches(
        request_buckets(log.withWatermark("ts", delay)),
        lambda rows, batch_id: store_batch(rows, batch_id, path),
        checkpoint,
        "update",
    )


def read_request_windows(spark: SparkSession, path: str) -> DataFrame:
    return request_windows(read_latest(spark, path, REQUEST_BUCKETS, ["window_start", "bucket"]))


# --- prediction to actual --------------------------------------------------------------------


def match_actuals(predictions: DataFrame, actuals: DataFrame, hours: int) -> DataFrame:
    """Inner join on the order, the delivery within `hours` after the prediction time."""
    made, arrived = F.col("prediction_timestamp"), F.col("delivered_at")
    known = actuals.select(
        F.col("order_id").alias("actual_order_id"), "delivered_at", "delivery_time_minutes"
    )
    in_time = (arrived >= made) & (arrived <= made + F.make_dt_interval(hours=F.lit(hours)))
    return predictions.join(
        known, (F.col("order_id") == F.col("actual_order_id")) & in_time
    ).drop("actual_order_id")


def stream_actuals_match(
    predictions: DataFrame,
    actuals: DataFrame,
    path: str,
    checkpoint: str,
    hours: int = 4,
    delay: str = DEFAULT_DELAY,
) -> StreamingQuery:
    """Both sides carry a watermark, so state is dropped once no partner can arrive."""
    joined = match_actuals(
        predictions.withWatermark("prediction_timestamp", delay),
        actuals.withWatermark("delivered_at", delay),
        hours,
    )
    return drain(joined.writeStream.format("parquet").option("path", path), checkpoint)


# --- duplicates ------------------------------------------------------------------------------


def stream_dedup(
    predictions: DataFrame, path: str, checkpoint: str, delay: str = DEFAULT_DELAY
) -> StreamingQuery:
    """The first copy of each (order, model version) within the watermark.

    Two steps: per source task group, then overall. However many copies one key has, only one
    per group reaches the task that owns the key.
    """
    key = ["order_id", "model_version"]
    unique = (
        predictions.withWatermark("prediction_timestamp", delay)
        .withColumn("_group", F.spark_partition_id() % DEDUP_GROUPS)
        .dropDuplicatesWithinWatermark([*key, "_group"])
        .drop("_group")
        .dropDuplicatesWithinWatermark(key)
    )
    return drain(unique.writeStream.format("parquet").option("path", path), checkpoint)


# --- last-N monitor --------------------------------------------------------------------------

MONITOR = (
    "model_version string, order_id bigint, prediction_timestamp timestamp, prediction double, "
    "actual double"
)


def last_per_model(rows: DataFrame, n: int) -> DataFrame:
    """The n latest rows per model. The rank filter runs before the shuffle as well, so a model
    with most of the rows sends at most n of them per task."""
    newest = Window.partitionBy("model_version").orderBy(
        F.col("prediction_timestamp").desc(), F.col("order_id").desc()
    )
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def stream_monitor(log: DataFrame, path: str, checkpoint: str, n: int = 1000) -> StreamingQuery:
    """Keep the n latest predictions per model: after each batch, state = last n of (state of the
    batch before, new rows). The state is a table of at most n rows per model; if that of the batch
    before is gone, the job stops instead of starting from nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/state-{batch_id - 1}"
        rows = batch
        if batch_id > 0:
            if not path_exists(spark, before):
                raise FileNotFoundError(f"monitor state {before} is lost")
            rows = spark.read.schema(MONITOR).parquet(before).unionByName(batch)
        last_per_model(rows, n).write.mode("overwrite").parquet(f"{path}/state-{batch_id}")

    columns = [c.split()[0] for c in MONITOR.split(", ")]
    return run_batches(log.select(*columns), handle, checkpoint)


def read_monitor(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.schema(MONITOR).parquet(f"{path}/state-{batch_id}")


def monitor_summary(state: DataFrame) -> DataFrame:
    """Size, mean prediction, MAE and bias of the kept predictions per model."""
    error = F.col("prediction") - F.col("actual")
    return state.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("prediction").alias("avg_prediction"),
        F.count("actual").alias("n_actuals"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("mean_error"),
    )
