"""Stored history: pruning to what the targets can see, and the open rolling aggregates."""

import random
import re
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from etaforge.operators.pit import (
    AGGREGATES,
    Mergeable,
    Partial,
    RollingAgg,
    register_aggregate,
    rolling_features,
)
from etaforge.operators.registry import FeatureSpec, Registry
from etaforge.plans import features as feats
from etaforge.plans import scoring
from etaforge.sources import commerce, history

SF = "/root/testdata/sf0.001"
WEEK = ("1996-03-04 00:00:00", "1996-03-11 00:00:00")


@pytest.fixture(scope="module")
def stored(spark):
    path = tempfile.mkdtemp(prefix="history-")
    history.write_history(commerce.orders(spark, SF), path, "month", splits=2)
    return path


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_stored_history_is_the_delivered_orders(spark, stored):
    back = history.read_history(spark, stored).drop(history.PERIOD_COLUMN)
    want = history.delivered(commerce.orders(spark, SF)).select(*back.columns)
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


def test_reloading_a_period_replaces_it_and_leaves_the_others(spark, stored, tmp_path):
    path = str(tmp_path / "h")
    orders = commerce.orders(spark, SF)
    history.write_history(orders, path, "year", splits=1)
    before = history.read_history(spark, path).count()
    history.write_history(orders.where("year(delivered_at) = 1994"), path, "year", splits=1)
    assert history.read_history(spark, path).count() == before


def test_week_of_training_features_prunes_history(spark, stored):
    t, past = commerce.tables(spark, SF), history.read_history(spark, stored)
    week = feats.training_features(t, *WEEK, history=past, period="month")
    # columns are pruned: the plan names each pass's scan of the stored history once
    filters = re.findall(r"PartitionFilters: \[([^\]]*delivered_period[^\]]*)\]", plan(week))
    assert len(filters) == 2  # store and customer pass
    for f in filters:
        assert ">= 1996-02-01" in f and "<= 1996-03-01" in f
    # delivered_at bounds reach the scan as well
    assert plan(week).count("GreaterThanOrEqual(delivered_at") >= 2
    seen = history.visible_history(past, WEEK, 30, "month")
    months = {r[0] for r in seen.select(F.regexp_extract(F.input_file_name(), "delivered_period=([0-9-]+)", 1)).distinct().collect()}
    assert months <= {"1996-02-01", "1996-03-01"}
    first, last = (datetime.fromisoformat(x) for x in WEEK)
    want = past.where(F.col("delivered_at").between(first - timedelta(days=30), last)).count()
    assert 0 < seen.count() <= want < past.count() / 10


def test_week_equals_the_rows_of_the_whole_set(spark, stored):
    t, past = commerce.tables(spark, SF), history.read_history(spark, stored)
    week = feats.training_features(t, *WEEK, history=past, period="month")
    whole = feats.training_features(t).where(F.col("created_at").between(*map(F.lit, WEEK)))
    key = lambda r: r["order_id"]
    assert sorted(week.collect(), key=key) == sorted(whole.collect(), key=key) != []


def test_open_sides_and_spans(spark, stored):
    past = history.read_history(spark, stored)
    assert history.visible_history(past, (None, None), 30).count() == past.count()
    assert "delivered_period" in plan(history.visible_history(past, (WEEK[0], None), 30, "month"))
    low, high = history.span_of(commerce.orders(spark, SF))
    assert low <= high and history.span_of(past.limit(0), "delivered_at") == (None, None)
    assert history.visible_history(past, (low, high + timedelta(days=400)), 4000, "month").count() == past.count()


def order_rows(spark, *rows):
    features = ", ".join(f"{n} double" for n in (*scoring.STORE_FEATURES, *scoring.CUSTOMER_FEATURES))
    df = spark.createDataFrame(rows, f"order_id bigint, store_id bigint, customer_id bigint, created_at string, {features}")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_history_is_not_read_where_the_snapshot_has_all(spark):
    requests = order_rows(spark, (1, 1, 1, "2024-01-31 10:00:00", 30.0, 4.0, 2.0))
    past = spark.range(1).select(
        F.raise_error(F.lit("history was read")).cast("bigint").alias("store_id"), F.lit(1).alias("customer_id"),
        F.lit("2024-01-30").cast("timestamp").alias("delivered_at"), F.lit(1.0).alias("delivery_time_minutes"),
    )
    assert scoring.fill_from_history(requests, past).collect() == requests.collect()
    lacking = order_rows(spark, (1, 1, 1, "2024-01-31 10:00:00", None, None, 2.0))
    with pytest.raises(Exception, match="history was read"):
        scoring.fill_from_history(lacking, past).collect()


def test_batch_reads_only_the_periods_of_its_misses(spark, tmp_path):
    """A folder outside the windows holds a file that is no Parquet: reading it would fail."""
    path = tmp_path / "h"
    orders = spark.createDataFrame(
        [(i, 1, 7, f"2024-01-{d:02d} 10:00:00", f"2024-01-{d:02d} 10:30:00") for i, d in enumerate((2, 20, 30))],
        "order_id bigint, store_id bigint, customer_id bigint, created_at string, delivered_at string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "delivered_at")})
    history.write_history(orders, str(path), "day")
    broken = path / "delivered_period=2020-01-01"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    past = history.read_history(spark, str(path))
    with pytest.raises(Exception):  # noqa: B017
        past.collect()
    requests = order_rows(
        spark,
        (10, 1, 7, "2024-01-31 10:00:00", None, None, None),
        (11, 2, 7, "2024-02-05 10:00:00", 12.0, 3.0, None),
        (12, None, None, "2024-02-05 10:00:00", None, None, None),
    )
    got = {r["order_id"]: tuple(r)[4:] for r in scoring.fill_from_history(requests, past).collect()}
    assert got[10] == (30.0, 3, 3) and got[11] == (12.0, 3, 2) and got[12] == (0.0, 0, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_distinct_counts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = datetime(1969, 12, 20)

    def moment():
        micros = rng.choice([0, 0, 500_000])
        return base + timedelta(seconds=rng.randrange(0, 70 * 86_400, rng.choice([7_200, 43_200])), microseconds=micros)

    key = lambda: rng.choice([1, 1, 1, 2, None])
    targets = [(i, key(), moment()) for i in range(300)]
    past = [(key(), moment(), rng.choice(["a", "a", "b", "c", "d", "e", None])) for _ in range(600)]
    aggs = [RollingAgg(f"d{days}", "distinct", days, "who") for days in (1, 7, 30)]
    aggs.append(RollingAgg("n7", "count", 7))
    got = rolling_features(
        spark.createDataFrame(targets, "id int, k int, at timestamp"),
        spark.createDataFrame(past, "k int, e timestamp, who string").withColumn("v", F.lit(1.0)),
        "k", "at", "e", "v", aggs,
    ).collect()
    assert len(got) == len(targets) and max(r["d30"] for r in got) > 3
    for r in got:
        end = r["at"].replace(microsecond=0)
        for days in (1, 7, 30):
            inside = [w for k, e, w in past if k is not None and k == r["k"] and end - timedelta(days=days) <= e < end]
            assert r[f"d{days}"] == len(set(inside) - {None}), r
            assert days != 7 or r["n7"] == len(inside)


def test_distinct_counts_hold_one_span_of_a_hot_pair(spark):
    """One customer makes all of a store's visits for two years: partial rows stay within spans."""
    visits = spark.range(0, 2 * 365 * 24).select(
        F.lit(1).alias("k"), F.lit(9).alias("who"), F.timestamp_seconds(F.col("id") * 3600).alias("e"), F.lit(1.0).alias("v")
    )
    targets = visits.select("k", F.col("e").alias("at")).where("hour(at) = 5")
    out = rolling_features(targets, visits, "k", "at", "e", "v", [RollingAgg("d", "distinct", 30, "who")])
    assert out.where("d <> 1").count() == 0 and out.count() == 730
    assert "part" in plan(out) and "RangeFrame" not in plan(out)


def test_medians_lie_within_the_stated_rank_error(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(3, 1) for _ in range(6000)]
    past = spark.createDataFrame([(1, 86_400 + i * 100, v) for i, v in enumerate(values)], "k int, s long, v double")
    past = past.select("k", F.timestamp_seconds("s").alias("e"), "v")
    targets = spark.createDataFrame([(1, 86_400 + i * 100) for i in (10, 150, 2000, 6000)], "k int, s long")
    targets = targets.select("k", F.timestamp_seconds("s").alias("at"), ((F.col("s") - 86_400) / 100).cast("int").alias("n"))
    out = rolling_features(targets, past, "k", "at", "e", "v", [RollingAgg("m", "median", 30)]).collect()
    for r in out:
        inside = sorted(values[: r["n"]])
        assert r["m"] in inside
        at = inside.index(r["m"])
        off = max(at / r["n"] - 0.5, 0.5 - (at + 1) / r["n"], 0)
        assert off == 0 if r["n"] < 200 else off <= 0.03, r
    empty = rolling_features(targets, past.limit(0), "k", "at", "e", "v", [RollingAgg("m", "median", 30)])
    assert {r["m"] for r in empty.collect()} == {0.0}


def test_registered_aggregate_works_in_features(spark):
    """A user's own aggregate: the range, and the share of values over 40, from mergeable pieces."""
    over = lambda: Partial("over40", (F.col("value") > 40).cast("long"), F.sum)
    if "over40_share" not in AGGREGATES:
        register_aggregate("value_range", Mergeable(
            lambda: (*AGGREGATES["min"].pieces(), *AGGREGATES["max"].pieces()), lambda piece: piece("hi") - piece("lo")))
        register_aggregate("over40_share", Mergeable(
            lambda: (over(), *AGGREGATES["count"].pieces()),
            lambda piece: F.try_divide(piece("over40"), piece("n"))))
    with pytest.raises(ValueError, match="exists"):
        register_aggregate("mean", AGGREGATES["sum"])
    registry = Registry([
        FeatureSpec("range_30d", "restaurant", "value_range", 30),
        FeatureSpec("late_30d", "restaurant", "over40_share", 30),
        FeatureSpec("customers_30d", "restaurant", "distinct", 30, of="customer_id"),
    ])
    past = spark.createDataFrame(
        [(1, 1, c, f"2024-01-{d:02d} 10:00:00", float(m)) for d, m, c in ((1, 30, 5), (2, 50, 5), (3, 45, 6))],
        "order_id int, store_id int, customer_id int, delivered_at string, delivery_time_minutes double",
    ).withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))
    targets = spark.sql("select 9 as order_id, 1 as store_id, 4 as customer_id, timestamp '2024-01-05 00:00:00' as created_at")
    row = registry.compute(targets, past).first()
    assert (row["range_30d"], round(row["late_30d"], 6), row["customers_30d"]) == (20.0, 0.666667, 2)
    hashes = {r["feature_name"]: r["definition_hash"] for r in registry.metadata(spark).collect()}
    assert len(set(hashes.values())) == 3


def test_distinct_windows_are_aggregated_apart(spark):
    """The steps of all windows in one aggregation would make a task's memory grow with the windows."""
    rows = spark.createDataFrame([(1, 5, "2024-01-01 00:00:00", 1.0)], "k long, who long, e string, v double")
    rows = rows.withColumn("e", F.col("e").cast("timestamp"))
    aggs = [RollingAgg(f"d{days}", "distinct", days, "who") for days in (1, 7, 30)]
    out = rolling_features(rows.select("k", F.col("e").alias("at")), rows, "k", "at", "e", "v", aggs)
    steps = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "sum(delta" in line]
    assert len(steps) == 3 and not any("span" in line for line in steps)


def test_distinct_needs_its_column():
    with pytest.raises(ValueError):
        RollingAgg("x", "distinct", 30)
    with pytest.raises(ValueError):
        RollingAgg("x", "mean", 30, "customer_id")
