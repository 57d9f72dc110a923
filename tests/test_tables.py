import pytest
from pyspark.sql import functions as F

from etaforge.operators import accuracy, online, validate
from etaforge.operators.conform import candidate_relationships, conform_orders, relationship_coverage
from etaforge.operators.joins import fanout_left_join, latest_per_key, side_by_side
from etaforge.plans import materialize, scoring
from etaforge.plans.features import latest_creation, training_base
from etaforge.session import scratch_dir
from etaforge.sources import keyed, profile
from etaforge.sources.tables import DeliveryTables


def ts(text):
    return F.lit(text).cast("timestamp")


# --- joins -----------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_fanout_join_equals_left_join(spark, hot_rows):
    """A third of the right rows, all of them copies, share one key."""
    left = spark.range(40).selectExpr("case when id = 39 then null else id end as k", "id as payload")
    right = spark.range(300).selectExpr(
        "case when id % 3 = 0 then 7 when id = 1 then null else id % 50 end as k",
        "case when id % 3 = 0 then 1 else id end as v",
    )
    got = fanout_left_join(left, right, "k", hot_rows).select("k", "payload", "v")
    want = left.join(right, "k", "left").select("k", "payload", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_latest_per_key(rows):
    df = rows([("a", 1, 10.0), ("a", 3, 30.0), ("a", 2, 20.0), ("b", 1, None)], "k string, t int, v double")
    got = sorted(tuple(r) for r in latest_per_key(df, ["k"], ["t"]).collect())
    assert got == [("a", 3, 30.0), ("b", 1, None)]


def test_side_by_side_keeps_missing(spark):
    one = spark.range(1).selectExpr("5 as a")
    assert side_by_side(one, spark.range(0).selectExpr("id as b")).first().asDict() == {"a": 5, "b": None}


# --- conform ---------------------------------------------------------------------------------


@pytest.fixture()
def star(spark, rows):
    return {
        "orders": rows(
            [(1, 10, 100, "2024-01-01 11:00:00"), (2, 11, None, "2024-01-01 11:00:00"), (3, 99, 100, None)],
            "order_id bigint, store_id bigint, customer_id bigint, delivered_at timestamp",
        ),
        "stores": rows([(10, 1.5), (11, 2.5)], "store_id bigint, latitude double"),
        "order_items": rows([(1, 3), (1, 4), (3, 9)], "order_id bigint, quantity bigint"),
        "regions": rows([(1,)], "region_id bigint"),
    }


def test_candidates_leave_out_the_table_itself(star):
    found = candidate_relationships({n: df.columns for n, df in star.items()})
    assert {(r.child, r.child_column, r.parent) for r in found} == {
        ("orders", "store_id", "stores"),
        ("order_items", "order_id", "orders"),
    }


def test_star_join(star):
    mapping = {
        "order_id": "orders.order_id",
        "at": "orders.Delivered_AT",
        "store": {"maps_to": "stores.store_id"},
        "lat": "stores.latitude",
        "qty": "order_items.quantity",
        "later": "YOUR_TABLE.YOUR_COLUMN",
    }
    got = conform_orders(star, mapping, base="orders", view="conformed_test")
    assert sorted(
        ((r.order_id, r.store, r.lat, r.qty) for r in got.collect()), key=str
    ) == sorted([(1, 10, 1.5, 3), (1, 10, 1.5, 4), (2, 11, 2.5, None)], key=str)
    assert got.sparkSession.table("conformed_test").count() == 3


def test_unmatched_store_is_null_in_the_conformed_row(star):
    mapping = {"order_id": "orders.order_id", "store": "stores.store_id", "customer": "orders.customer_id"}
    got = conform_orders(star, mapping, delivered_only=False).where("order_id = 3").first()
    assert got.store is None


def test_unreachable_table_is_an_error(star):
    with pytest.raises(ValueError, match="regions"):
        conform_orders(star, {"a": "orders.order_id", "b": "regions.region_id"}, base="orders")


def test_coverage_counts_orphans(star):
    found = candidate_relationships({n: df.columns for n, df in star.items()})
    got = {r.child_table: r for r in relationship_coverage(star, found).collect()}
    assert (got["orders"].matched_rows, got["orders"].orphan_keys) == (2, 1)
    assert (got["order_items"].child_rows, got["order_items"].orphan_keys) == (3, 0)


# --- tables with a key -----------------------------------------------------------------------

PREDICTION = (
    "order_id string, model_version string, predicted double, created_at timestamp, seq bigint, "
    "prediction_period date"
)


def prediction(order, version, minutes, at, seq=0, period="2024-01-01"):
    return (order, version, minutes, f"2024-02-01 00:00:{at:02d}", seq, period)


def stored(spark, path):
    table = spark.read.parquet(path)
    return {(r.order_id, r.model_version): r.predicted for r in table.collect()}


def test_upsert_keeps_the_latest(spark, rows):
    path = scratch_dir(spark, "t-upsert")

    def frame(*data):
        loose = PREDICTION.replace("prediction_period date", "prediction_period string")
        return rows(list(data), loose).withColumn("prediction_period", F.col("prediction_period").cast("date"))

    keyed.upsert(frame(prediction("o1", "v1", 10.0, 1), prediction("o9", "v1", 1.0, 1, period="2024-03-01")), path)
    second = frame(prediction("o1", "v1", 12.0, 2), prediction("o1", "v2", 11.0, 2))
    want = {("o1", "v1"): 12.0, ("o1", "v2"): 11.0, ("o9", "v1"): 1.0}
    for _ in range(2):  # the second run changes nothing
        keyed.upsert(second, path)
        assert stored(spark, path) == want
    keyed.upsert(frame(prediction("o1", "v1", 10.0, 1)), path)  # an old value does not win
    assert stored(spark, path) == want
    keyed.upsert(frame(prediction("o1", "v1", 13.0, 2, seq=1)), path)  # same time, later insert
    assert stored(spark, path)[("o1", "v1")] == 13.0


def test_csv_export_leaves_out_system_tables(spark, rows):
    df = rows([(1, "2024-01-01 00:00:00.123456", None, 'a "b", c')],
              "id bigint, at timestamp, x double, s string")
    paths = keyed.export_csv({"t": df, "sqlite_sequence": df}, scratch_dir(spark, "t-csv"))
    assert list(paths) == ["t"]
    assert keyed.read_csv(spark, paths["t"], df.schema).collect() == df.collect()


def test_snapshot_replaces_only_its_own_partition(spark, rows):
    orders = rows(
        [(1, "2024-01-01 10:00:00", "2024-01-01 10:30:00"), (2, "2024-01-05 10:00:00", "2024-01-05 11:00:00"),
         (None, "2024-01-01 10:00:00", "2024-01-01 10:30:00")],
        "store_id bigint, created_at timestamp, delivered_at timestamp",
    )
    path = scratch_dir(spark, "t-snapshots")
    materialize.materialize(orders, "store_id", "2024-01-02 00:00:00", path)
    materialize.materialize(orders, "store_id", "2024-01-10 00:00:00", path)
    got = materialize.materialize(orders, "store_id", "2024-01-10 00:00:00", path, 7)
    got = materialize.materialize(orders, "store_id", "2024-01-10 00:00:00", path, 7)
    kept = sorted((str(r.computed_at), r.window_days, r.store_id) for r in got.collect())
    assert kept == [
        ("2024-01-02 00:00:00", 30, 1),
        ("2024-01-10 00:00:00", 7, 2),
        ("2024-01-10 00:00:00", 30, 1),
        ("2024-01-10 00:00:00", 30, 2),
    ]
    assert materialize.entity_count(got, "store_id", "2024-01-10 00:00:00").first()[0] == 2


def test_required_columns(spark):
    df = spark.range(2).selectExpr("nullif(id, 1) as ORDER_ID", "id as colour")
    got = {r[0]: r[1:] for r in profile.required_columns(df, ["order_id", "total"]).collect()}
    assert got == {"order_id": ("present", 1), "total": ("missing", None), "colour": ("extra", 0)}


def test_profile_finds_the_key(rows):
    df = rows([(1, 5, "a"), (2, 5, None)], "order_id bigint, store_id bigint, note string")
    got = {r.column_name: r for r in profile.profile_table(df, "t").collect()}
    assert [got[c].is_key for c in ("order_id", "store_id", "note")] == [True, False, False]
    assert (got["note"].null_count, got["note"].distinct_count, got["order_id"].max_value) == (1, None, "2")


# --- online features -------------------------------------------------------------------------


def online_rows(spark, rows, updated, ttl):
    wide = rows([("s1", 33.0, 4)], "store_id string, avg double, n bigint")
    return online.long_features(wide, "restaurant", "store_id", ["avg", "n"], ts(updated), ttl)


@pytest.mark.parametrize(
    "ttl, now, found",
    [
        (86_400, "2024-01-02 00:00:00", None),  # exactly at the end: expired
        (86_400, "2024-01-01 23:59:59", 33.0),
        (86_400, "2024-01-02 00:00:01", None),
        (None, "2030-01-01 00:00:00", 33.0),
        (0, "2030-01-01 00:00:00", 33.0),
    ],
)
def test_online_values_expire(spark, rows, ttl, now, found):
    cache = online_rows(spark, rows, "2024-01-01 00:00:00", ttl)
    asked = rows([("s1",), ("s2",)], "store_id string")
    got = online.lookup(asked, cache, "restaurant", "store_id", ["avg", "n"], ts(now)).collect()
    assert {r.store_id: r.avg for r in got} == {"s1": found, "s2": None}


def test_a_later_write_replaces_value_and_expiry(spark, rows):
    """As in a key-value store: the old value does not come back when the new one expires."""
    old = online_rows(spark, rows, "2024-01-01 00:00:00", None)
    new = online_rows(spark, rows, "2024-01-02 00:00:00", 60).withColumn("value", F.col("value") + 1)
    asked, both = rows([("s1",)], "store_id string"), old.unionByName(new)
    for now, want in (("2024-01-02 00:00:30", 34.0), ("2024-01-02 00:02:00", None)):
        got = online.lookup(asked, both, "restaurant", "store_id", ["avg"], ts(now)).first()
        assert got.avg == want


def test_fallback_is_per_group(rows):
    df = rows(
        [(None, 5.0, 1.0, 2.0, None, 9.0), (30.0, None, 1.0, 2.0, 4.0, 9.0)],
        "c_avg double, c_n double, x_avg double, x_n double, c_cust double, x_cust double",
    )
    got = online.with_fallback(df, "c_", "x_", ["avg", "n"], ["cust"]).collect()
    # No cached average: the whole store group is computed. With it, a missing count stays missing.
    assert [(r.avg, r.n, r.cust) for r in got] == [(1.0, 2.0, 9.0), (30.0, None, 4.0)]


# --- accuracy --------------------------------------------------------------------------------


@pytest.fixture()
def errors(rows):
    def make(data):
        df = rows(data, "order_id string, predicted_delivery_minutes double, actual_delivery_minutes double")
        return accuracy.with_errors(df)

    return make


def test_accuracy_fixture(errors):
    df = errors([("a", 30.0, 20.0), ("b", 25.0, 30.0), ("c", 40.0, 40.0)])
    got = accuracy.overall(df).first()
    assert got.mae == 5 and got.median_absolute_error == 5
    assert got.rmse == pytest.approx(6.454972, abs=1e-6)
    assert got.mean_percentage_error == pytest.approx(22.222222, abs=1e-6)
    bands = {r.minutes: r.within for r in accuracy.bands(df).collect()}
    assert bands == {5: 2, 10: 3, 15: 3}


def test_zero_actual(errors):
    df = errors([("a", 5.0, 0.0)])
    assert df.first().percentage_error is None
    assert accuracy.overall(df).first().zero_actuals == 1


def test_no_predictions(errors):
    got = accuracy.overall(errors([])).first()
    assert got.n == 0 and got.mae is None and got.median_absolute_error is None


def test_describe_counts_nulls(rows):
    df = rows([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    got = accuracy.describe(df, ["x"]).first()
    assert (got["count"], got.null_count, got.min, got.median, got.max) == (3, 1, 1.0, 2.0, 4.0)
    assert accuracy.describe(df, ["x"], "nearest").first().q75 == 4.0


# --- validation and requests -----------------------------------------------------------------


def test_one_violation_per_rule(rows):
    df = rows(
        [("o1", 5, 1, 3, "2024-01-01 00:00:00"), ("o1", -1, 0, 24, None)],
        "order_id string, total bigint, quantity bigint, hour_of_day bigint, created_at timestamp",
    )
    checks = [
        validate.Check("order_id", "unique"),
        validate.Check("total", "min", 0),
        validate.Check("quantity", "min", 1),
        validate.Check("hour_of_day", "max", 23),
        validate.Check("created_at", "not_null"),
    ]
    got = {r.rule: r.violations for r in validate.violations(df, checks).collect()}
    assert got == {c.rule: 1 for c in checks}


def test_a_bad_order_does_not_stop_the_batch(spark):
    order = (
        "named_struct('order_id', {0}L, 'customer_id', 1L, 'store_id', 1L, 'latitude', 47.0D, "
        "'longitude', -122.0D, 'delivery_latitude', 47.1D, 'delivery_longitude', -122.1D, "
        "'total', 4500L, 'quantity', {1}, 'created_at', '{2}')"
    )
    orders = ", ".join(
        [order.format(1, "5L", "2024-03-15T14:30:00"), order.format(2, "0L", "not-a-date")]
    )
    requests = spark.sql(f"select 'r' as request_id, array({orders}) as orders")
    checked = validate.with_reasons(scoring.explode_requests(requests), scoring.scoring_rules())
    assert validate.batch_outcome(checked, "request_id").first()[1:] == (2, 1, 1)
    bad = validate.rejected_rows(checked).first()
    assert (bad.order_id, bad.reasons, bad.quantity) == (2, ["no creation time"], 1)
    assert validate.valid_rows(checked).first().quantity == 5


# --- scoring ---------------------------------------------------------------------------------


@pytest.fixture()
def tables(rows):
    orders = rows(
        [
            ("a", "c", "s1", 100, "2024-01-01 10:00:00", "2024-01-01 10:01:00", "2024-01-01 10:30:00"),
            ("b", "c", "s1", 100, "2024-01-02 10:00:00", "2024-01-02 10:01:00", None),
            ("d", "c", "s2", 100, "2024-01-03 10:00:00", "2024-01-03 10:01:00", None),
            ("e", "c", "s1", 100, "2024-01-04 10:00:00", None, None),
            ("f", "c", "s1", -5, "2024-01-05 10:00:00", "2024-01-05 10:01:00", None),
        ],
        "order_id string, customer_id string, store_id string, total bigint, created_at timestamp, "
        "confirmed_at timestamp, delivered_at timestamp",
    ).selectExpr("*", "47.0D as delivery_latitude", "-122.0D as delivery_longitude")
    stores = rows([("s1", 47.0, -122.0), ("s2", None, None)],
                  "store_id string, latitude double, longitude double")
    return DeliveryTables(orders, stores, rows([("b", 2), ("b", 3)], "order_id string, quantity bigint"))


def test_batch_scoring_with_text_keys(tables):
    predictions, rejects = scoring.score_batch(tables, scoring.rule_scores, created_at=ts("2024-02-01"))
    got = predictions.collect()
    assert [(r.order_id, r.predicted_delivery_minutes) for r in got] == [("b", 30.0)]
    assert '"quantity":5' in got[0].features_json
    assert str(got[0].prediction_timestamp) == "2024-01-02 10:00:00"
    assert [(r.order_id, r.reasons) for r in rejects.collect()] == [("f", ["negative total"])]


def test_limit_takes_the_newest(tables):
    assert [r.order_id for r in scoring.confirmed_orders(tables, limit=1).collect()] == ["f"]
    assert [r.order_id for r in scoring.confirmed_orders(tables, ordered=True).collect()] == ["f", "b"]


def test_training_base_is_half_open_and_ordered(rows):
    orders = rows(
        [(i, f"2024-01-0{d} 00:00:00", f"2024-01-0{d} 00:30:00") for i, d in enumerate((3, 1, 2))],
        "order_id bigint, created_at timestamp, delivered_at timestamp",
    )
    base = training_base(orders, "2024-01-01 00:00:00", latest_creation(orders), ordered=True)
    assert [r.order_id for r in base.collect()] == [1, 2]


def test_expired_cache_falls_back_to_computed(tables, rows):
    cached = rows([("s1", 50.0, 9)], "store_id string, a double, n bigint").withColumnsRenamed(
        dict(zip(("a", "n"), scoring.STORE_FEATURES))
    )
    cache = online.long_features(cached, "restaurant", "store_id", scoring.STORE_FEATURES,
                                 ts("2024-01-01 00:00:00"))
    for now, want in (("2024-01-01 12:00:00", 50.0), ("2024-01-02 00:00:01", 30.0)):
        predictions, _ = scoring.score_batch(
            tables, scoring.rule_scores, online=cache, now=ts(now), created_at=ts("2024-02-01")
        )
        assert predictions.first().predicted_delivery_minutes == want
