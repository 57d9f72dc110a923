import pytest
from pyspark.sql import functions as F

from etaforge.functions import clock, guards
from etaforge.functions.geo import haversine_km
from etaforge.functions.jsonmap import decode_features, encode_features
from etaforge.plans.features import with_order_features


def distance(spark, a, b):
    lit = [F.lit(x).cast("double") for x in (*a, *b)]
    return spark.range(1).select(haversine_km(*lit)).first()[0]


def test_distance_of_a_point_to_itself(spark):
    assert distance(spark, (47.6, -122.3), (47.6, -122.3)) == 0.0


def test_known_distance(spark):
    found = distance(spark, (47.6062, -122.3321), (45.5152, -122.6784))
    assert 230 < found < 240
    assert found == pytest.approx(234.0105, abs=1e-3)


def test_distance_is_symmetric(spark):
    a, b = (47.6, -122.3), (45.5, -122.6)
    assert distance(spark, a, b) == pytest.approx(distance(spark, b, a), abs=1e-9)


def test_distance_extremes(spark):
    assert distance(spark, (0.0, 0.0), (0.0, 180.0)) == pytest.approx(20015.0868, abs=1e-3)
    assert distance(spark, (None, 0.0), (1.0, 1.0)) is None


@pytest.mark.parametrize(
    "at, hour, weekday, weekend",
    [
        ("2024-03-15 14:30:00", 14, 4, False),
        ("2024-03-16 12:00:00", 12, 5, True),
        ("2024-03-18 12:00:00", 12, 0, False),
    ],
)
def test_order_features(rows, at, hour, weekday, weekend):
    df = rows(
        [(at, 47.6, -122.3, 47.61, -122.31, 2500, 3)],
        "created_at timestamp, latitude double, longitude double, delivery_latitude double, "
        "delivery_longitude double, total bigint, quantity bigint",
    )
    r = with_order_features(df).first()
    assert (r.hour_of_day, r.day_of_week, r.is_weekend) == (hour, weekday, weekend)
    assert (r.total, r.quantity) == (2500, 3)
    assert r.distance_km > 0


def test_elapsed_minutes_keeps_microseconds(rows):
    df = rows([("2024-01-01 11:30:00", "2024-01-01 12:00:00.5")], "a timestamp, b timestamp")
    minutes = df.select(clock.elapsed_minutes(F.col("a"), F.col("b"))).first()[0]
    assert minutes == pytest.approx(30.008333, abs=1e-6)


def test_bad_time_is_null_not_an_error(rows):
    df = rows([("not-a-date",), ("2024-01-01T10:00:00",), (None,)], "t string")
    got = [r[0] for r in df.select(clock.format_iso(clock.parse_iso(F.col("t")))).collect()]
    assert got == [None, "2024-01-01T10:00:00", None]


def test_parts_of_a_time_are_no_time(rows):
    bad = ["2024", "2024-01", "T10:00", "10:00", "2024-13-01T00:00:00", "2024-01-01T", "1704067200", ""]
    good = ["2024-01-01", "2024-01-01 10:00", "2024-01-01T10:00:00.123", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+01:00"]
    df = rows([(t,) for t in bad + good], "t string")
    got = {r[0]: r[1] for r in df.select("t", clock.parse_iso(F.col("t"))).collect()}
    assert all(got[t] is None for t in bad) and all(got[t] is not None for t in good)


def test_quantity_rules(rows):
    df = rows([(None,), (0,), (4,)], "q bigint")
    got = df.select(guards.quantity_or_one(F.col("q")), guards.request_quantity(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 1), (4, 4)]


def test_percentage_of_zero_is_null(rows):
    df = rows([(5.0, 0.0), (5.0, 20.0)], "p double, w double")
    assert [r[0] for r in df.select(guards.percent_of(F.col("p"), F.col("w"))).collect()] == [None, 25.0]


def test_model_inputs_replace_null_and_nan(rows):
    df = rows([(None, True), (float("nan"), False), (2.0, None)], "x double, b boolean")
    got = [tuple(r) for r in guards.model_inputs(df, ["x", "b"]).collect()]
    assert got == [(-1.0, 1.0), (-1.0, 0.0), (2.0, -1.0)]


def test_feature_map_round_trip(rows):
    df = rows([(1.5, None, True)], "a double, n bigint, flag boolean")
    text = df.select(encode_features(["a", "n", "flag"]).alias("j"))
    assert '"n":null' in text.first().j
    back = text.select(decode_features(F.col("j"), "a double, n bigint, flag boolean").alias("f"))
    assert tuple(back.first().f) == (1.5, None, True)
