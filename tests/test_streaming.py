import pytest
from pyspark.sql import functions as F

from etaforge import catalog
from etaforge.plans import scoring
from etaforge.plans.features import delivered
from etaforge.session import scratch_dir
from etaforge.sources import commerce
from etaforge.sources.commerce import lifecycle_events
from etaforge.streaming import jobs, sinks


@pytest.fixture()
def place(spark):
    home = scratch_dir(spark, "t-stream")
    return lambda name: f"{home}/{name}"


def in_files(df, path, column, files):
    """Write `df` as several files in order of `column`, one micro-batch each."""
    ranked = df.withColumn("_f", F.expr(f"ntile({files}) over (order by {column})"))
    for i in range(1, files + 1):
        ranked.where(f"_f = {i}").drop("_f").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same_rows(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def orders(spark, n=200):
    return spark.range(n).selectExpr(
        "id as order_id", "id % 9 as customer_id", "id * 10 as total",
        "timestamp_seconds(1704067200 + id * 600) as created_at",
        "case when id % 3 <> 0 then timestamp_seconds(1704067260 + id * 600) end as confirmed_at",
        "case when id % 3 = 1 then timestamp_seconds(1704069000 + id * 600) end as delivered_at",
    )


def test_lifecycle_over_batches_and_restart(spark, place):
    """Events of one order are spread over micro-batches; a restart adds nothing."""
    events = lifecycle_events(orders(spark)).withColumn("_mix", F.xxhash64("order_id", "event_type"))
    stream = in_files(events, place("in"), "_mix", 4)
    want = jobs.lifecycle_of_events(events)
    for _ in range(2):
        jobs.stream_lifecycle(stream, place("out"), place("ck"))
        assert same_rows(jobs.read_lifecycles(spark, place("out")), want)
    jobs.compact_lifecycles(spark, place("out"), place("compact"))
    assert same_rows(jobs.read_lifecycles(spark, place("compact")), want)
    assert want.count() == 200
    done = want.where("order_id = 1").first()
    assert done.delivered_at is not None and done.driver_id == 1 and done.total == 10


def test_first_event_of_a_kind_wins(spark):
    twice = lifecycle_events(orders(spark, 5))
    again = twice.withColumns({"event_at": F.expr("event_at + interval 1 hour"), "total": F.lit(-1).cast("long")})
    assert same_rows(jobs.lifecycle_of_events(twice.unionByName(again)), jobs.lifecycle_of_events(twice))


def test_replayed_batch_replaces_itself(spark, place):
    rows = spark.range(3).selectExpr("id as a")
    for _ in range(2):
        sinks.store_batch(rows, 0, place("out"))
    assert sinks.read_batches(spark, place("out"), "a bigint").count() == 3
    assert sinks.read_batches(spark, place("nothing"), "a bigint").count() == 0


def test_store_metrics_over_batches(spark, place):
    rows = spark.range(400).selectExpr(
        "id % 5 as store_id", "timestamp_seconds(1704067200 + id * 7200) as delivered_at",
        "cast(id % 60 as double) as delivery_time_minutes",
    )
    stream = in_files(rows, place("in"), "delivered_at", 3)
    jobs.stream_store_days(stream, place("out"), place("ck"))
    days = jobs.read_store_days(spark, place("out"))
    sliding = rows.groupBy("store_id", F.window("delivered_at", "30 days", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delivery_time_minutes").alias("avg_minutes")
    ).select("store_id", F.col("w.start").alias("window_start"), "n", "avg_minutes")

    def rounded(df):
        return df.withColumn("avg_minutes", F.round("avg_minutes", 9))

    assert same_rows(rounded(jobs.sliding_windows(days)), rounded(sliding))


def test_late_rows_are_dropped_and_counted(spark, place):
    log = spark.range(20).selectExpr(
        "id", "timestamp_seconds(1704067200 + id * 1800) as ts", "5.0D as prediction", "1.0D as latency_ms"
    )
    late = log.where("id = 0").withColumn("id", F.lit(99).cast("long"))
    # Lateness is judged by the watermark of the batch before: the first late copy still counts.
    for part in (log, late, late):
        part.coalesce(1).write.mode("append").parquet(place("in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(place("in"))
    query = jobs.stream_request_windows(stream, place("out"), place("ck"))
    got = jobs.read_request_windows(spark, place("out"))
    assert got.agg(F.sum("total_requests")).first()[0] == 21
    assert sinks.dropped_late(query) >= 1


def test_actuals_match_in_time_only(spark, place, rows):
    predictions = rows(
        [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:00:00"), (3, "2024-01-01 10:00:00")],
        "order_id bigint, prediction_timestamp timestamp",
    )
    actuals = rows(
        [(1, "2024-01-01 10:30:00", 30.0), (2, "2024-01-01 15:00:00", 300.0), (3, "2024-01-01 09:59:59", 0.0)],
        "order_id bigint, delivered_at timestamp, delivery_time_minutes double",
    )
    made = sinks.arrivals(predictions, "t-p", "prediction_timestamp", 2)
    for stream, arrived in zip(made, sinks.arrivals(actuals, "t-a", "delivered_at", 2), strict=True):
        jobs.stream_actuals_match(stream, arrived, place("out"), place("ck"), 4)
    twin = jobs.match_actuals(predictions, actuals, 4)
    assert [r.order_id for r in twin.collect()] == [1]
    assert same_rows(spark.read.schema(twin.schema).parquet(place("out")), twin)


def test_dedup_across_batches(spark, place):
    rows = spark.range(30).selectExpr(
        "id % 10 as order_id", "'v1' as model_version",
        "timestamp_seconds(1704067200 + id) as prediction_timestamp",
    )
    jobs.stream_dedup(in_files(rows, place("in"), "prediction_timestamp", 3), place("out"), place("ck"))
    assert spark.read.parquet(place("out")).count() == 10


def test_monitor_keeps_the_last_n_per_model(spark, place):
    log = spark.range(500).selectExpr(
        "case when id % 3 = 0 then 'a' else 'b' end as model_version", "id as order_id",
        "timestamp_seconds(1704067200 + id) as prediction_timestamp",
        "cast(id as double) as prediction", "cast(id + 1 as double) as actual",
    )
    query = jobs.stream_monitor(in_files(log, place("in"), "order_id", 4), place("out"), place("ck"), n=50)
    state = jobs.read_monitor(spark, place("out"), query.lastProgress["batchId"])
    assert same_rows(state, jobs.last_per_model(log, 50))
    assert {r.model_version: r.n for r in jobs.monitor_summary(state).collect()} == {"a": 50, "b": 50}
    plan = jobs.last_per_model(log, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_scoring_stream_upserts_and_rejects(spark, place, rows):
    requests = rows(
        [(1, 5, 7, "2024-01-01 10:00:00", 47.0), (2, 5, 8, "2024-01-01 10:00:00", None),
         (3, 5, 9, "2024-01-01 10:00:00", 47.0)],
        "order_id bigint, customer_id bigint, store_id bigint, created_at timestamp, latitude double",
    ).selectExpr(
        "*", "-122.0D as longitude", "47.0D as delivery_latitude", "-122.0D as delivery_longitude",
        "100L as total", "1L as quantity",
    )
    snapshot = rows(
        [("restaurant", "7", scoring.STORE_FEATURES[0], 33.0), ("restaurant", "7", scoring.STORE_FEATURES[1], 4.0)],
        "entity_type string, entity_id string, feature_name string, value double",
    ).selectExpr("*", "timestamp'2024-01-01' as updated_at", "timestamp'2024-01-02' as expires_at")
    stream = in_files(requests, place("in"), "order_id", 2)
    now, made = F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    for _ in range(2):
        jobs.stream_scoring(
            stream, snapshot, scoring.rule_scores, place("out"), place("bad"), place("ck"), now, made
        )
        got = {r.order_id: r.predicted_delivery_minutes for r in spark.read.parquet(place("out")).collect()}
        assert got == {1: 33.0, 3: 45.0}
        assert [r.order_id for r in spark.read.parquet(place("bad")).collect()] == [2]


def test_scoring_stream_computes_what_the_snapshot_lacks(spark, place, rows):
    """Store 7 is live, 8 expired, 9 absent, 6 without history; a null customer has no orders."""
    requests = rows(
        [(k, customer, store, "2024-01-10 10:00:00") for k, customer, store in
         ((1, 1, 7), (2, 2, 8), (3, 3, 9), (4, None, 6), (4, None, 6))],
        "order_id bigint, customer_id bigint, store_id bigint, created_at timestamp",
    ).selectExpr(
        "*", "47.0D as latitude", "-122.0D as longitude", "47.0D as delivery_latitude",
        "-122.0D as delivery_longitude", "100L as total", "1L as quantity",
    )
    avg, count, own = *scoring.STORE_FEATURES, scoring.CUSTOMER_FEATURES[0]
    snapshot = rows(
        [("restaurant", "7", avg, 33.0, "2024-01-11"), ("restaurant", "7", count, 4.0, "2024-01-11"),
         ("restaurant", "8", avg, 99.0, "2024-01-10"), ("restaurant", "8", count, 4.0, "2024-01-10"),
         ("customer", "1", own, 5.0, "2024-01-11"), ("customer", "2", own, 6.0, "2024-01-10")],
        "entity_type string, entity_id string, feature_name string, value double, expires_at timestamp",
    ).selectExpr("*", "timestamp'2024-01-01' as updated_at")
    history = rows(
        [(1, 7, "2024-01-09 10:00:00", 10.0), (2, 8, "2024-01-09 10:00:00", 20.0),
         (2, 8, "2024-01-08 10:00:00", 30.0), (2, 8, "2024-01-10 10:00:00", 90.0),
         (2, 8, "2023-12-01 10:00:00", 90.0), (3, 9, "2024-01-09 10:00:00", 40.0)],
        "customer_id bigint, store_id bigint, delivered_at timestamp, delivery_time_minutes double",
    )
    stream = in_files(requests, place("in"), "order_id", 2)
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    jobs.stream_scoring(
        stream, snapshot, scoring.rule_scores, place("out"), place("bad"), place("ck"), now, now, history=history
    )
    out = spark.read.parquet(place("out"))
    assert {r.order_id: r.predicted_delivery_minutes for r in out.collect()} == {1: 33.0, 2: 25.0, 3: 40.0, 4: 45.0}
    customers = out.select("order_id", F.get_json_object("features_json", f"$.{own}").cast("double").alias("n"))
    assert {r.order_id: r.n for r in customers.collect()} == {1: 5.0, 2: 2.0, 3: 1.0, 4: 0.0}


def test_scoring_stream_with_aged_snapshot_equals_batch(spark, place):
    root, now = "/root/testdata/sf0.001", F.lit(catalog.AS_OF).cast("timestamp")
    t = commerce.tables(spark, root)
    history, online = delivered(t.orders), catalog._aged(catalog._online(spark, root)).localCheckpoint()
    requests = scoring.confirmed_orders(t).where("delivery_latitude is not null and delivery_longitude is not null and total >= 0")
    batch = scoring.rule_scores(scoring.inference_features(requests, history, online, now))
    stream = in_files(requests, place("in"), "order_id", 2)
    jobs.stream_scoring(
        stream, online, scoring.rule_scores, place("out"), place("bad"), place("ck"), now, now, "year", history
    )
    columns = ["order_id", "round(predicted_delivery_minutes, 6) as minutes"]
    got = spark.read.parquet(place("out")).selectExpr(*columns)
    assert got.count() > 0 and same_rows(got, batch.selectExpr(*columns))


def test_portions_arrive_in_time_order_and_whole(spark, place):
    rows = spark.range(100).selectExpr(
        "id", "case when id > 0 then timestamp_seconds(1704067200 + (id * 37) % 50) end as ts"
    )
    seen, batches = [], 0
    for stream in sinks.arrivals(rows, "t-arrive", "ts"):
        def keep(batch, batch_id):
            seen.append([r.ts for r in batch.collect()])
        query = sinks.run_batches(stream, keep, place("ck"))
        batches += 1
    assert batches == 5 and sum(map(len, seen)) == 100 and query.lastProgress["batchId"] == 4
    times = [sorted(t for t in batch if t) for batch in seen]
    assert all(a[-1] < b[0] for a, b in zip(times, times[1:]))


def test_lost_monitor_state_stops_the_job(spark, place):
    log = spark.range(20).selectExpr(
        "'a' as model_version", "id as order_id", "timestamp_seconds(id) as prediction_timestamp",
        "1.0D as prediction", "2.0D as actual",
    )
    portions = sinks.arrivals(log, "t-log", "prediction_timestamp", 2)
    jobs.stream_monitor(next(portions), place("out"), place("ck"))
    with pytest.raises(Exception, match="lost"):
        jobs.stream_monitor(next(portions), place("elsewhere"), place("ck"))


def test_later_batch_wins_at_one_storing_time(spark, place, rows):
    made = F.lit("2024-01-01").cast("timestamp")
    order = rows([(1, 5, 7, "2024-01-01 10:00:00")], "order_id bigint, customer_id bigint, store_id bigint, created_at timestamp").selectExpr(
        "*", "47.0D as latitude", "-122.0D as longitude", "-122.0D as delivery_longitude", "100L as total", "1L as quantity"
    )
    none = spark.createDataFrame(
        [], "entity_type string, entity_id string, feature_name string, value double, updated_at timestamp, expires_at timestamp"
    )
    for far in (1.0, 0.0):
        sent = order.withColumn("delivery_latitude", F.lit(47.0 + far))
        sent.write.mode("append").parquet(place("in"))
        stream = spark.readStream.schema(sent.schema).parquet(place("in"))
        jobs.stream_scoring(stream, none, scoring.rule_scores, place("out"), place("bad"), place("ck"), made, made)
    assert [r.predicted_delivery_minutes for r in spark.read.parquet(place("out")).collect()] == [45.0]
