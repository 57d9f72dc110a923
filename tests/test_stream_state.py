"""Streams with keyed state, sketches and kept late rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from etaforge.functions.buckets import ACCURACY, LOWEST, bucket_value, log_bucket
from etaforge.session import scratch_dir
from etaforge.sources import commerce
from etaforge.streaming import jobs, late, sinks
from etaforge.streaming import keyed as keyed_state
from test_streaming import in_files, same_rows

START = 1704067200


@pytest.fixture()
def place(spark):
    home = scratch_dir(spark, "t-state")
    return lambda name: f"{home}/{name}"


# --- latency percentiles ---------------------------------------------------------------------


def request_rows(spark, n=4000):
    rng = random.Random(3)
    rows = [
        (i, START + rng.randrange(0, 5 * 3600), 5.0 if rng.random() < 0.9 else None, rng.choice([0.0, rng.lognormvariate(3, 1.5)]))
        for i in range(n)
    ]
    rows += [(n, START, 5.0, None), (n + 1, START, 5.0, float("nan")), (n + 2, START + 9 * 3600, None, 3.0)]
    df = spark.createDataFrame(rows, "id long, s long, prediction double, latency_ms double")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_percentiles_are_within_one_percent_of_the_exact_ones(spark):
    log = request_rows(spark).where("latency_ms is not null and not isnan(latency_ms)")
    got = {r["window_start"]: r for r in jobs.request_windows(jobs.request_buckets(log)).collect()}
    exact = {}
    for r in log.where("prediction is not null").withColumn("w", F.date_trunc("hour", "ts")).collect():
        exact.setdefault(r["w"], []).append(r["latency_ms"])
    assert len(got) == len(exact) + 1
    for w, values in exact.items():
        values.sort()
        assert got[w]["successful_requests"] == len(values)
        for name, share in (("p50_latency_ms", 0.5), ("p95_latency_ms", 0.95)):
            want = values[int(len(values) * share)]
            assert abs(got[w][name] - want) <= ACCURACY * want * (1 + 1e-9), (w, name)
    failed_only = next(r for w, r in got.items() if w not in exact)
    assert failed_only["error_requests"] == 1 and failed_only["p50_latency_ms"] is None and failed_only["avg_latency_ms"] is None


def test_percentiles_do_not_depend_on_batches_or_replays(spark, place):
    log = request_rows(spark).where("not isnan(latency_ms) or latency_ms is null")
    twin = jobs.request_windows(jobs.request_buckets(log))
    counts = [c for c in twin.columns if c != "avg_latency_ms"]
    for files in (1, 5):
        stream = in_files(log, place(f"in-{files}"), "ts", files)
        for _ in range(2):  # a restart adds nothing
            jobs.stream_request_windows(stream, place(f"out-{files}"), place(f"ck-{files}"))
        assert same_rows(jobs.read_request_windows(spark, place(f"out-{files}")).select(*counts), twin.select(*counts))


def test_buckets_rise_with_values(spark):
    values = [0.0, -1.0, 1e-12, 1e-6, 0.5, 0.99, 1.0, 1.01, 7.0, 1e9]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    rows = df.select("v", log_bucket(F.col("v")).alias("b")).withColumn("e", bucket_value(F.col("b"))).collect()
    known = [r for r in rows[: len(values)]]
    assert [r["b"] for r in known[:3]] == [LOWEST] * 3 and known[0]["e"] == 0.0
    assert [r["b"] for r in known[3:]] == sorted(r["b"] for r in known[3:])
    assert all(abs(r["e"] - r["v"]) <= ACCURACY * r["v"] * (1 + 1e-9) for r in known[3:])
    assert rows[-2]["b"] is None and rows[-1]["b"] is None


# --- order closures --------------------------------------------------------------------------

EVENT = "order_id long, event_type string, minute long, customer_id long, total long, driver_id long"


def event_rows(spark, rows):
    df = spark.createDataFrame([(o, kind, at, o * 10 if o else None, 5, 3) for o, kind, at in rows], EVENT)
    return df.withColumn("event_at", F.timestamp_seconds(START + F.col("minute") * 60)).drop("minute")


def minutes_of(row, column):
    return None if row[column] is None else (row[column].timestamp() - START) / 60


def closures(spark, place, rows, files, **limits):
    """Rows in files by their place in the list."""
    events = event_rows(spark, rows)
    parts = len(rows) // files
    for i in range(files):
        part = rows[i * parts :] if i == files - 1 else rows[i * parts : (i + 1) * parts]
        event_rows(spark, part).coalesce(1).write.mode("append").parquet(place("in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place("in"))
    query = keyed_state.stream_order_closures(stream, place("out"), place("ck"), **limits)
    got = {r["order_id"]: r for r in keyed_state.read_closures(spark, place("out")).collect()}
    return query, got


def test_orders_close_by_delivery_cancellation_or_silence(spark, place):
    rows = [
        (1, "placed", 0), (2, "placed", 0), (3, "placed", 1), (4, "placed", 2), (None, "placed", 2), (5, "refunded", 2),
        (1, "delivered", 50), (1, "picked_up", 40), (1, "assigned", 20), (2, "cancelled", 30), (2, "cancelled", 25), (4, "assigned", 60),
        (1, "delivered", 70), (3, "assigned", 90), (3, "assigned", 80), (6, "placed", 95), (6, "cancelled", 99), (4, "picked_up", 100),
        (9, "placed", 10_000), (9, "placed", 10_000),
    ]
    query, got = closures(spark, place, rows, 3, timeout_hours=24, grace_hours=1)
    assert {o: r["outcome"] for o, r in got.items()} == {1: "delivered", 2: "cancelled", 3: "abandoned", 4: "abandoned", 6: "cancelled"}
    one = got[1]
    assert [minutes_of(one, f"{s}_at") for s in jobs.STEPS] == [0, 20, 40, 50, None]
    assert (one["customer_id"], one["total"], one["driver_id"], minutes_of(one, "closed_at")) == (10, 5, 3, 50)
    assert minutes_of(got[2], "cancelled_at") == minutes_of(got[2], "closed_at") == 25
    assert minutes_of(got[3], "assigned_at") == 80 and minutes_of(got[3], "closed_at") == 90 + 24 * 60
    assert minutes_of(got[4], "closed_at") == 100 + 24 * 60
    # Only the order that moved the watermark is still held.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    again = closures(spark, place, rows[:0] or rows, 3, timeout_hours=24, grace_hours=1)  # same files: a second copy arrives late
    assert set(again[1]) == set(got)


def test_closure_rows_equal_the_lifecycle_fold(spark, place):
    orders = commerce.orders(spark, "/root/testdata/sf0.001", with_store=False)
    events = commerce.lifecycle_events(orders)
    keyed_state.stream_order_closures(sinks.staged(events, "t-ev", "event_at"), place("out"), place("ck"))
    got = keyed_state.read_closures(spark, place("out"))
    fold = jobs.lifecycle_of_events(events)
    both = got.drop("outcome", "closed_at").join(fold.withColumnRenamed("order_id", "o"), F.col("order_id") == F.col("o"))
    assert got.count() == both.count() > 0.9 * fold.count()
    assert same_rows(got.drop("outcome", "closed_at"), fold.join(got.select("order_id"), "order_id"))


def test_open_orders_share_the_state_rows_and_python_calls_of_their_group(spark, place):
    """Orders are folded in groups: 400 open ones are at most 4 rows of state, and all close as before."""
    rows = [(o, "placed", o % 7) for o in range(400)] + [(o, "delivered", 20 + o % 5) for o in range(0, 400, 2)]
    rows += [(1, "cancelled", 24), (3, "delivered", 25), (3, "cancelled", 25), (1000, "placed", 200)]
    query, got = closures(spark, place, rows, 3, timeout_hours=24, grace_hours=1, groups=4)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    assert set(got) == {*range(0, 400, 2), 1, 3}
    assert {got[o]["outcome"] for o in range(0, 400, 2)} == {"delivered"}
    assert got[1]["outcome"] == got[3]["outcome"] == "cancelled"
    for o in range(0, 400, 2):
        assert minutes_of(got[o], "placed_at") == o % 7 and minutes_of(got[o], "closed_at") == 20 + o % 5
        assert (got[o]["customer_id"], got[o]["total"], got[o]["driver_id"], got[o]["assigned_at"]) == (o * 10 or None, 5, None, None)


def test_repeats_of_a_hot_order_are_shrunk_before_its_task(spark):
    hot = spark.range(20_000).selectExpr(
        "1L as order_id", "'placed' as event_type", f"timestamp_seconds({START} + id) as event_at", "1L as customer_id", "1L as total", "1L as driver_id"
    ).repartition(4)
    rows = keyed_state.step_rows(hot)
    left = rows.mapInPandas(keyed_state.shrink, rows.schema)
    assert left.count() <= 2 * 4 * 2
    assert left.agg(F.min("us"), F.max("us")).first() == rows.agg(F.min("us"), F.max("us")).first()


# --- last-N state ----------------------------------------------------------------------------


def monitor_log(spark, n=3000):
    return spark.range(n).selectExpr(
        "case when id % 10 = 0 then 'a' else 'b' end as model_version", "id as order_id",
        f"timestamp_seconds({START} + id * 60) as prediction_timestamp",
        "cast(id as double) as prediction", "case when id % 2 = 0 then cast(id + 1 as double) end as actual",
    )


def test_newest_rows_as_state_over_twenty_batches(spark, place):
    log = monitor_log(spark)
    query = keyed_state.stream_newest(in_files(log, place("in"), "order_id", 20), place("out"), place("ck"), n=40, salts=4)
    assert same_rows(keyed_state.read_newest(spark, place("out"), 40), jobs.last_per_model(log, 40))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    memory = [p["stateOperators"][0]["memoryUsedBytes"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 20 and max(sizes) == 8  # a row per model and salt
    assert memory[-1] < 2 * memory[9]
    for (key,), rows in [((r[0],), r) for r in keyed_state.read_newest(spark, place("out"), 40).groupBy("model_version").count().collect()]:
        assert rows["count"] == 40, key


def test_silent_models_leave_the_state(spark, place):
    log = monitor_log(spark, 400)
    quiet = log.where("model_version = 'a' and order_id < 50")
    busy = log.where("model_version = 'b'").withColumn("prediction_timestamp", F.expr("prediction_timestamp + interval 90 day"))
    for part in (quiet, busy, busy.withColumn("order_id", F.col("order_id") + 10_000)):
        part.coalesce(1).write.mode("append").parquet(place("in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(place("in"))
    keyed_state.stream_newest(stream, place("out"), place("ck"), n=20, salts=2, ttl_days=30)
    kept = keyed_state.read_newest(spark, place("out"), 20)
    assert {r["model_version"] for r in kept.select("model_version").distinct().collect()} == {"b"}


# --- late rows -------------------------------------------------------------------------------

STORE = "order_id long, store_id long, s long, delivery_time_minutes double"
STORE_TS = "order_id bigint, store_id bigint, delivered_at timestamp, delivery_time_minutes double"


def deliveries(spark, rows):
    df = spark.createDataFrame([(o, o % 3, START + m * 60, float(o)) for o, m in rows], STORE)
    return df.select("order_id", "store_id", F.timestamp_seconds("s").alias("delivered_at"), "delivery_time_minutes")


BATCHES = [
    [(1, 0), (2, 30), (3, 600)],
    [(4, 540), (5, 539), (6, 700), (7, 5)],  # no watermark yet
    [(8, 541), (9, 540), (10, 539), (11, 800)],  # watermark of the batch before: minute 540
    [(12, 641), (13, 640), (14, 5)],  # minute 640
]


def test_late_rows_are_kept_counted_and_merged(spark, place):
    for rows in BATCHES:
        deliveries(spark, rows).coalesce(1).write.mode("append").parquet(place("in"))
    stream = spark.readStream.schema(deliveries(spark, BATCHES[0]).schema).option("maxFilesPerTrigger", 1).parquet(place("in"))
    jobs.stream_store_days_with_late(stream, place("out"), place("ck"), "1 hour")
    kept = late.read_late(spark, place("out"), STORE_TS)
    assert sorted(r["order_id"] for r in kept.collect()) == [9, 10, 13, 14]
    ledger = late.read_ledger(spark, place("out")).orderBy("batch_id").collect()
    assert [(r["rows"], r["late_rows"], r["greatest_ms"]) for r in ledger] == [
        (3, 0, (START + 600 * 60) * 1000), (4, 0, (START + 700 * 60) * 1000), (4, 2, (START + 800 * 60) * 1000), (3, 2, (START + 641 * 60) * 1000)
    ]
    every = deliveries(spark, [r for rows in BATCHES for r in rows])
    assert same_rows(jobs.read_store_days_with_late(spark, place("out"), STORE_TS), jobs.store_days(every))
    in_time = every.where(~F.col("order_id").isin(9, 10, 13, 14))
    assert same_rows(jobs.read_store_days_with_late(spark, place("out"), STORE_TS, merge_late=False), jobs.store_days(in_time))
    # A replayed batch meets the watermark it met before.
    assert late.watermark_before(spark, place("out"), 2, "1 hour") == ledger[2]["watermark_ms"] == (START + 540 * 60) * 1000
    assert late.watermark_before(spark, place("out"), 1, "1 hour") is None


def test_late_rows_are_those_that_spark_drops(spark, place):
    """The same batches through an operator that drops late rows itself."""
    for rows in BATCHES:
        deliveries(spark, rows).coalesce(1).write.mode("append").parquet(place("in"))
    stream = spark.readStream.schema(deliveries(spark, BATCHES[0]).schema).option("maxFilesPerTrigger", 1).parquet(place("in"))
    unique = stream.withWatermark("delivered_at", "1 hour").dropDuplicatesWithinWatermark(["order_id"])
    query = sinks.drain(unique.writeStream.format("parquet").option("path", place("out")), place("ck"))
    jobs.stream_store_days_with_late(stream, place("late"), place("late-ck"), "1 hour")
    counted = late.read_ledger(spark, place("late")).agg(F.sum("late_rows")).first()[0]
    assert sinks.dropped_late(query) == counted == 4
    passed = spark.read.parquet(place("out")).select("order_id")
    assert passed.intersect(late.read_late(spark, place("late"), STORE_TS).select("order_id")).isEmpty()


@pytest.mark.parametrize(("text", "ms"), [("1 hour", 3_600_000), ("90 minutes", 5_400_000), ("2 Days", 172_800_000), ("0 seconds", 0)])
def test_delays(text, ms):
    assert late.delay_ms(text) == ms


@pytest.mark.parametrize("text", ["soon", "1 fortnight", "-1 hour", ""])
def test_unknown_delays_are_refused(text):
    with pytest.raises(ValueError):
        late.delay_ms(text)


def test_staged_portions_are_one_query_with_a_batch_each(spark, place):
    rows = spark.range(100).select("id", F.timestamp_seconds(START + F.col("id")).alias("at"))
    seen = []
    stream = sinks.staged(rows.repartition(7), "t-staged", "at")
    sinks.run_batches(stream, lambda df, i: seen.append(sorted(r["id"] for r in df.collect())), place("ck"))
    assert len(seen) == 5 and [x for part in seen for x in part] == list(range(100))
