import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from etaforge.operators.pit import KINDS, RollingAgg, features_as_of, rolling_features
from etaforge.operators.registry import FeatureSpec, Registry
from etaforge.plans.features import delivered, with_store_history

ORDER = "order_id string, store_id bigint, created_at timestamp, delivered_at timestamp"
EDGES = [
    ("h1", 1, "2024-01-01 10:00:00", "2024-01-01 10:30:00"),
    ("h2", 1, "2024-01-01 11:00:00", "2024-01-01 12:00:00"),
    ("h3", 1, "2024-01-01 11:30:00", "2024-01-01 12:00:00.5"),
    ("t1", 1, "2024-01-01 12:00:00.9", "2024-01-01 12:40:00"),
    ("t2", 1, "2024-01-31 10:30:00", "2024-01-31 11:30:00"),
    ("t3", 1, "2024-01-31 10:30:01", "2024-01-31 11:00:00"),
    ("t4", None, "2024-01-31 10:30:00", "2024-01-31 11:00:00"),
]


def store_features(orders):
    out = with_store_history(orders, delivered(orders)).collect()
    return {
        r.order_id: (r.restaurant_order_count_30d, round(r.restaurant_avg_delivery_minutes_30d, 6))
        for r in out
    }


def test_window_edges(rows):
    got = store_features(rows(EDGES, ORDER))
    assert got["h1"] == (0, 0.0)  # empty window
    assert got["t1"] == (1, 30.0)  # as_of floored to the second, h2 delivered exactly then
    assert got["t2"] == (4, 39.998333)  # h1 delivered exactly at the window start
    assert got["t3"] == (3, 43.331111)  # one second later h1 is out
    assert got["t4"] == (0, 0.0)  # a NULL key matches nothing


def test_later_orders_change_nothing(rows):
    later = [(f"f{i}", 1, "2024-02-01 00:00:00", f"2024-02-0{i + 1} 00:00:00") for i in range(5)]
    before = store_features(rows(EDGES, ORDER))
    after = store_features(rows(EDGES + later, ORDER))
    assert {k: after[k] for k in before} == before


def brute_force(targets, history, kind, days):
    out = {}
    for tid, key, at in targets:
        end = at.replace(microsecond=0)
        start = end - timedelta(days=days)
        inside = [v for k, e, v in history if key is not None and k == key and start <= e < end]
        known = [v for v in inside if v is not None]
        n = len(known)
        if kind == "count":
            out[tid] = len(inside)
        elif not known:
            out[tid] = 0.0
        elif kind == "mean":
            out[tid] = sum(known) / n
        elif kind == "sum":
            out[tid] = sum(known)
        elif kind in ("min", "max"):
            out[tid] = (min if kind == "min" else max)(known)
        else:
            mean = sum(known) / n
            out[tid] = (sum((v - mean) ** 2 for v in known) / (n - 1)) ** 0.5 if n > 1 else 0.0
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_aggregates_equal_brute_force(spark, seed):
    """Half of the rows share one key, times collide, and some lie before 1970."""
    rng = random.Random(seed)
    base = datetime(1969, 12, 20)

    def moment():
        micros = rng.choice([0, 0, 500_000, 999_999])
        return base + timedelta(seconds=rng.randrange(0, 40 * 86_400, 7_200), microseconds=micros)

    def key():
        return rng.choice([1, 1, 1, 2, 3, None])

    targets = [(i, key(), moment()) for i in range(300)]
    history = [
        (key(), moment(), rng.choice([None, 30.0, 45.1, rng.uniform(5, 90)])) for _ in range(500)
    ]
    aggs = [RollingAgg(f"{kind}_{days}", kind, days) for days in (1, 7, 30) for kind in KINDS]
    got = rolling_features(
        spark.createDataFrame(targets, "id int, k int, at timestamp"),
        spark.createDataFrame(history, "k int, e timestamp, v double"),
        "k", "at", "e", "v", aggs,
    ).collect()
    assert len(got) == len(targets)
    for agg in aggs:
        want = brute_force(targets, history, agg.kind, agg.window_days)
        for r in got:
            assert r[agg.name] == pytest.approx(want[r.id], abs=1e-6), (agg, r)


def test_copies_of_a_target_each_get_the_answer(rows):
    doubled = EDGES + [("t2", 1, "2024-01-31 10:30:00", None)]
    orders = rows(doubled, ORDER)
    out = with_store_history(orders, delivered(orders)).where("order_id = 't2'").collect()
    assert [r.restaurant_order_count_30d for r in out] == [4, 4]


def test_moments_may_be_a_superset(rows):
    orders = rows(EDGES, ORDER)
    some = orders.where("order_id in ('t1', 't2', 't4')")
    got = with_store_history(some, delivered(orders), moments=orders).collect()
    assert {r.order_id: r.restaurant_order_count_30d for r in got} == {"t1": 1, "t2": 4, "t4": 0}


def test_no_task_holds_a_whole_key(rows):
    """The history is combined per second before it is shuffled, and never by key alone."""
    orders = rows(EDGES, ORDER)
    plan = with_store_history(orders, delivered(orders))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keyed = [s for s in shuffles if "hashpartitioning(span" in s]
    assert len(keyed) == 2
    assert all("part" in s or "_groupingexpression" in s for s in keyed)


def test_features_of_all_entities_at_one_moment(rows):
    orders = rows(EDGES, ORDER)
    stores = rows([(1,), (9,)], "store_id bigint")
    at = F.lit("2024-01-31 10:30:00").cast("timestamp")
    got = features_as_of(
        stores, delivered(orders), "store_id", at, "delivered_at", "delivery_time_minutes", 30
    ).collect()
    assert {r.store_id: (r.order_count, round(r.avg_delivery_minutes, 6)) for r in got} == {
        1: (4, 39.998333),
        9: (0, 0.0),
    }


def test_registry_replaces_by_name_and_hashes_definitions(spark):
    registry = Registry([FeatureSpec("a", "restaurant", "mean", 7)])
    first = registry.metadata(spark).first().definition_hash
    registry.register(FeatureSpec("a", "restaurant", "mean", 30))
    again = registry.metadata(spark).collect()
    assert len(again) == 1 and again[0].definition_hash != first


def test_unknown_aggregate_is_refused():
    with pytest.raises(ValueError):
        RollingAgg("x", "mode", 30)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([1_000_000 + i % 2 for i in range(1000)], 0.500250),
        ([1_700_000_000 + i for i in range(20)], 5.916080),
        ([0.1] * 50, 0.0),
        ([5.0], 0.0),
    ],
)
def test_spread_of_large_values(spark, values, want):
    history = spark.createDataFrame([(1, 86_400 + i, float(v)) for i, v in enumerate(values)], "k long, s long, v double")
    history = history.select("k", F.timestamp_seconds("s").alias("at"), "v")
    targets = spark.sql("select 1L as k, timestamp_seconds(200000) as as_of")
    out = rolling_features(targets, history, "k", "as_of", "at", "v", [RollingAgg("sd", "stddev", 30)])
    assert out.first()["sd"] == pytest.approx(want, abs=1e-6)


def test_unknown_entity_raises(spark):
    registry = Registry([FeatureSpec("driver_mean", "driver", "mean", 30)])
    with pytest.raises(ValueError, match="driver"):
        registry.compute(spark.range(1), spark.range(1))
