"""A stored reference gives the drift results of both samples, and is opened only in part."""

import random

import pytest

from etaforge.operators import drift, fitted
from etaforge.session import scratch_dir

COLUMNS = ["x", "y", "z", "flat", "none", "gone"]
SCHEMA = "x double, y double, z bigint, flat double, none double"


def sample(spark, seed, n, shift=0.0):
    rng = random.Random(seed)
    rows = [
        (
            rng.gauss(5 + shift, 2) if rng.random() > 0.1 else None,
            rng.choice([float("nan"), 0.0, -1e6, 3.25, rng.expovariate(0.01)]),
            rng.randrange(20),
            7.0,
            None,
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-99.0).collect())


@pytest.fixture(scope="module")
def reference(spark):
    return sample(spark, 1, 1500).withColumn("gone", drift.F.lit(1.0)).cache()


@pytest.fixture(scope="module")
def profile(spark, reference):
    path = scratch_dir(spark, "profile-test")
    fitted.fit(reference, COLUMNS, path)
    return path


@pytest.mark.parametrize(("seed", "n", "shift"), [(2, 900, 0.0), (3, 700, 1.5), (4, 300, 400.0), (5, 5, 0.0), (6, 0, 0.0)])
def test_equals_the_test_of_both_samples(spark, reference, profile, seed, n, shift):
    current = sample(spark, seed, n, shift)
    assert rounded(fitted.detect(current, profile)) == rounded(drift.check_all_features(reference, current, COLUMNS))


def test_column_that_only_the_current_sample_fills(spark, profile, reference):
    current = sample(spark, 8, 50).fillna(2.5, ["none"])
    got = fitted.detect(current, profile)
    assert rounded(got) == rounded(drift.check_all_features(reference, current, COLUMNS))
    assert got.where("feature_name = 'none'").count() == 2


def test_reads_a_part_of_the_stored_values(spark, profile):
    rows = fitted._stored_values(spark, profile)
    opened = rows.where("feature = 'x' and value between 4 and 4.01").select("feature", "bin").distinct()
    fresh = spark.createDataFrame([], "feature string, value double, r long, c long")
    wanted = fitted._values_of(fresh, profile, opened)
    folders = {(r.feature, r.cell) for r in rows.select("feature", "cell").distinct().collect()}
    assert 0 < wanted.count() < rows.where("feature = 'x'").count() / 10
    read = rows.where("feature = 'x' and cell in (1, 2)")
    assert "PartitionFilters: [" in read._jdf.queryExecution().toString()
    assert len({f for f, _ in folders}) == 5 and len(folders) > 10


def test_a_stored_profile_is_not_overwritten(reference, profile):
    with pytest.raises(Exception, match="already exists"):
        fitted.fit(reference, COLUMNS, profile)
