import math
import random

import numpy as np
import pytest

from etaforge.operators import drift
from etaforge.operators.monitor import last_rows, request_stats
from etaforge.operators.ranks import exact_quantiles, ks_distance
from etaforge.session import write_through

SAMPLES = {
    "uniform": lambda rng: [rng.uniform(0, 100) for _ in range(2001)],
    "heavy_tail": lambda rng: [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 12) for _ in range(1500)],
    "one_hot_value": lambda rng: [7.0] * 900 + [rng.gauss(7, 1e-9) for _ in range(600)],
    "narrow": lambda rng: [1.7e9 + rng.randrange(0, 5000) for _ in range(1500)],
    "constant": lambda rng: [5.0] * 40,
    "single": lambda rng: [3.25],
    "integers": lambda rng: [float(rng.randrange(-20, 20)) for _ in range(1000)],
}


@pytest.fixture(scope="module")
def wide(spark):
    """Samples of different lengths as the columns of one stored table, padded with NULL."""

    def make(label, columns, side=None):
        length = max(map(len, columns.values())) + 1
        padded = [values + [None] * (length - len(values)) for values in columns.values()]
        data = [(side, *row) for row in zip(*padded)]
        ddl = "side string, " + ", ".join(f"{name} double" for name in columns)
        return write_through(spark.createDataFrame(data, ddl), label)

    return make


@pytest.mark.parametrize("method", ["linear", "nearest", "index"])
def test_quantiles_are_exact(wide, method):
    columns = {name: make(random.Random(5)) + [float("nan")] for name, make in SAMPLES.items()}
    probabilities = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {
        (r.feature, r.probability): r.quantile
        for r in exact_quantiles(wide("t-q", columns), list(columns), probabilities, method).collect()
    }
    assert len(got) == len(columns) * len(probabilities)
    for name, values in columns.items():
        ordered = sorted(values[:-1])
        for p in probabilities:
            if method == "linear":
                want = float(np.quantile(ordered, p))
            elif method == "nearest":
                want = ordered[math.floor(p * (len(ordered) - 1) + 0.5)]
            else:
                want = ordered[min(int(len(ordered) * p), len(ordered) - 1)]
            assert got[name, p] == pytest.approx(want, rel=1e-12, abs=1e-15), (name, p)


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    a, b = np.sort(a), np.sort(b)
    fa = np.searchsorted(a, points, side="right") / len(a)
    fb = np.searchsorted(b, points, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


@pytest.mark.parametrize("shift", [0.0, 0.3, 1000.0])
def test_ks_distance_equals_brute_force(wide, shift):
    reference = {name: make(random.Random(1)) for name, make in SAMPLES.items()}
    current = {
        name: [v + shift for v in make(random.Random(2))][: max(1, len(reference[name]) // 2)]
        for name, make in SAMPLES.items()
    }
    both = wide("t-ref", reference, "ref").unionByName(wide("t-cur", current, "cur"))
    got = {r.feature: r for r in ks_distance(both, list(SAMPLES)).collect()}
    assert set(got) == set(SAMPLES)
    for name, r in got.items():
        assert r.d == pytest.approx(brute_ks(reference[name], current[name]), abs=1e-12), name
        assert (r.n_ref, r.n_cur) == (len(reference[name]), len(current[name]))
        assert r.ref_mean == pytest.approx(np.mean(reference[name]), rel=1e-9)


def samples(spark, reference, current):
    def frame(values):
        return spark.createDataFrame([(float(v),) for v in values], "x double")

    return drift.two_samples(frame(reference), frame(current), ["x"])


def test_ks_fixture(spark):
    got = drift.ks_test(samples(spark, range(1, 11), range(6, 16)), ["x"]).first()
    assert got.statistic == pytest.approx(0.5)
    assert got.p_value == pytest.approx(0.164079, abs=1e-6)
    assert not got.is_drifted
    assert (got.reference_mean, got.current_mean) == (5.5, 10.5)


def test_ks_equal_samples(spark):
    got = drift.ks_test(samples(spark, range(1, 11), range(1, 11)), ["x"]).first()
    assert (got.statistic, got.p_value, got.is_drifted) == (0.0, 1.0, False)


def test_too_small_sample(spark):
    pair = samples(spark, range(1, 10), range(1, 11))
    for got in (drift.ks_test(pair, ["x"]).first(), drift.psi_test(pair, ["x"]).first()):
        assert (got.statistic, got.p_value, got.is_drifted) == (0.0, 1.0, False)
        assert got.reference_mean is None and got.current_mean is None


def test_psi_fixture(spark):
    pair = samples(spark, range(10), [*range(9), 8])
    got = drift.psi_components(pair, ["x"]).first()
    assert got.psi_ratio == pytest.approx(0.1999001, abs=1e-6)
    assert got.psi_log == pytest.approx(0.7593995, abs=1e-6)
    assert not drift.psi_test(pair, ["x"]).first().is_drifted
    assert drift.psi_test(pair, ["x"], "psi_log").first().is_drifted


def test_psi_constant_and_equal(spark):
    for values in ([5] * 10, range(20)):
        got = drift.psi_components(samples(spark, values, values), ["x"]).first()
        assert (got.psi_ratio, got.psi_log) == (0.0, 0.0)


def test_columns_missing_on_one_side_are_skipped(spark):
    a = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "x double, y double")
    got = drift.check_all_features(a, a.drop("y"), ["x", "y", "z"]).collect()
    assert sorted((r.feature_name, r.test_name) for r in got) == [("x", "ks_test"), ("x", "psi")]


def test_report_lists_only_drifted(spark):
    a = spark.createDataFrame([(float(i), float(i)) for i in range(50)], "x double, y double")
    b = a.selectExpr("x + 100 as x", "y")
    got = drift.drift_report(drift.check_all_features(a, b, ["x", "y"])).first()
    assert (got.total_tests, got.drifted_count, got.drift_detected) == (4, 2, True)
    assert got.drifted_features == "x:ks_test,x:psi"


@pytest.mark.parametrize("logged, rows", [(99, 0), (100, 1)])
def test_prediction_drift_needs_a_long_log(spark, logged, rows):
    reference = spark.range(200).selectExpr("cast(id as double) as prediction")
    log = spark.range(logged).selectExpr("id", "cast(id as double) as prediction")
    assert drift.prediction_drift(reference, log, ["id"]).count() == rows


@pytest.mark.parametrize("known, rows", [(9, 0), (10, 1)])
def test_error_stats_need_known_actuals(spark, known, rows):
    df = spark.range(30).selectExpr(
        "cast(id as double) as prediction", f"case when id < {known} then id - 1.0e0 end as actual"
    )
    got = drift.error_stats(df).collect()
    assert len(got) == rows
    assert all((r.mae, r.mean_error, r.n_samples) == (1.0, 1.0, known) for r in got)


def test_profile_skips_flags(spark):
    df = spark.range(11).selectExpr("cast(id as double) as x", "id > 3 as flag", "id as n")
    got = {r.feature: r for r in drift.reference_profile(df, ["x", "flag", "n"]).collect()}
    assert set(got) == {"x", "n"}
    assert got["x"]["median"] == 5.0 and got["x"]["max"] == 10.0


def test_request_percentile_positions(spark):
    log = spark.range(1, 11).selectExpr(
        "id", "cast(id as double) as latency_ms", "20.0e0 as prediction", "cast(null as string) as error"
    )
    got = request_stats(log).first()
    assert (got.p50_latency_ms, got.p95_latency_ms, got.total_requests) == (6.0, 10.0, 10)


def test_request_stats_without_success(spark):
    log = spark.range(3).selectExpr(
        "id", "1.0e0 as latency_ms", "cast(null as double) as prediction", "'x' as error"
    )
    got = request_stats(log).first()
    assert (got.total_requests, got.successful_requests, got.error_requests) == (3, 0, 3)
    assert got.p50_latency_ms is None


def test_last_rows(spark):
    assert [r.id for r in last_rows(spark.range(10), ["id"], 3).collect()] == [9, 8, 7]
    assert last_rows(spark.range(10), ["id"], 0).count() == 0
