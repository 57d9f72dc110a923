import pytest
from pyspark.sql import functions as F

from etaforge.plans import model
from etaforge.session import scratch_dir

FEATURES = ["x", "y"]
SMALL = {"maxIter": 5, "maxDepth": 3}


@pytest.fixture(scope="module")
def training_set(spark):
    return spark.range(600).selectExpr(
        "id as order_id",
        "cast(id % 40 as double) as x",
        "case when id % 7 = 0 then null else cast(id % 5 as double) end as y",
        "20 + (id % 40) + cast(id % 3 as double) as delivery_time_minutes",
    )


def test_split_is_stable_and_about_a_fifth(training_set):
    split = model.with_split(training_set)
    moved = model.with_split(training_set.repartition(7)).where("is_test")
    share = split.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.14 < share < 0.26
    assert {r.order_id for r in split.where("is_test").collect()} == {r.order_id for r in moved.collect()}


def test_time_split(training_set):
    dated = training_set.limit(4).selectExpr("*", "timestamp_seconds(order_id) as created_at")
    split = model.with_time_split(dated, "1970-01-01 00:00:02")
    assert [r.is_test for r in split.orderBy("order_id").collect()] == [False, False, True, True]


def test_run_registers_saves_and_beats_the_mean(spark, training_set):
    home = scratch_dir(spark, "t-models")
    for version, day in (("v2", "2024-01-02"), ("v1", "2024-01-01")):
        run = model.run_training(
            training_set, home, version, f"{day} 00:00:00", features=FEATURES, **SMALL
        )
        assert run.metrics["r2"] > 0.8
        assert run.metrics["train_size"] + run.metrics["test_size"] == 600
    table = {r.version: r for r in model.registry(spark, home).collect()}
    assert set(table) == {"v1", "v2"} and table["v1"].metrics == run.metrics
    newest = model.load_latest(spark, home)
    assert newest.uid == model.PipelineModel.load(table["v2"].path).uid


def test_loaded_model_gives_the_same_scores(spark, training_set):
    home = scratch_dir(spark, "t-models")
    run = model.run_training(training_set, home, "v1", "2024-01-01 00:00:00", features=FEATURES, **SMALL)
    loaded = model.load_latest(spark, home)
    a = model.predict(run.model, training_set, FEATURES).orderBy("order_id").collect()
    b = model.predict(loaded, training_set, FEATURES).orderBy("order_id").collect()
    assert a == b
    assert a[0].y is None  # features keep their own values
    importance = model.feature_importance(spark, loaded, FEATURES).collect()
    assert {r.feature for r in importance} == {"x", "y"}
    assert sum(r.importance for r in importance) == pytest.approx(1.0)


def test_no_data_is_an_error(spark, training_set):
    with pytest.raises(ValueError, match="no training data"):
        model.run_training(training_set.limit(0), scratch_dir(spark, "t"), "v", "2024-01-01", features=FEATURES)
    with pytest.raises(ValueError, match="no model"):
        home = scratch_dir(spark, "t")
        model.register(spark, home, "other", "v", {}, "p", "2024-01-01 00:00:00")
        model.load_latest(spark, home)
