"""Boosted-tree regression with Spark ML: split, fit, score, importance, registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from etaforge.functions.guards import model_inputs
from etaforge.operators.accuracy import regression_metrics
from etaforge.operators.registry import TRAINING_FEATURES
from etaforge.session import shared_root, write_through
from etaforge.sources.keyed import append_log

LABEL = "delivery_time_minutes"
# Boosting rounds, depth, learning rate, seed and test share of a default run.
DEFAULTS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42}
TEST_PERCENT = 20


def split_bucket(key: str = "order_id") -> Column:
    """0..99 from the md5 of the key: stable under any partitioning and across engines."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100


def with_split(df: DataFrame, key: str = "order_id", test_percent: int = TEST_PERCENT) -> DataFrame:
    return df.withColumn("is_test", split_bucket(key) < test_percent)


def with_time_split(df: DataFrame, at: str, column: str = "created_at") -> DataFrame:
    return df.withColumn("is_test", F.col(column) >= F.lit(at).cast("timestamp"))


def fit(
    train: DataFrame, features: list[str] = TRAINING_FEATURES, validation: str | None = None, **params
) -> PipelineModel:
    """Fit on rows with a label; missing features are -1. `params` go to the regressor.

    `validation` names a boolean column: boosting then goes on, up to `maxIter` rounds, only while
    the error of those rows falls by more than `validationTol`, and they are not fitted.
    """
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # where boosting cuts its lineage
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    flag = [validation] if validation else []
    ready = model_inputs(train.where(F.col(LABEL).isNotNull()), features).select(*features, LABEL, *flag)
    if validation:
        params["validationIndicatorCol"] = validation
    stages = [
        VectorAssembler(inputCols=features, outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol=LABEL, **{**DEFAULTS, **params}),
    ]
    return Pipeline(stages=stages).fit(ready)


def predict(model: PipelineModel, df: DataFrame, features: list[str] = TRAINING_FEATURES) -> DataFrame:
    """`df` with `predicted_delivery_minutes`; feature columns keep their original values."""
    raw = {f"_raw_{name}": F.col(name) for name in features}
    scored = model.transform(model_inputs(df.withColumns(raw), features))
    restored = scored.withColumns({name: F.col(f"_raw_{name}") for name in features})
    return restored.withColumnRenamed("prediction", "predicted_delivery_minutes").drop(
        "features", *raw
    )


def evaluation_curve(model: PipelineModel, rows: DataFrame, features: list[str] = TRAINING_FEATURES) -> DataFrame:
    """Squared error and its root on `rows` after each boosting round; a row per round, one pass each
    over the assembled rows, which are stored first."""
    spark = rows.sparkSession
    known = model_inputs(rows.where(F.col(LABEL).isNotNull()), features).select(*features, LABEL)
    ready = write_through(model.stages[0].transform(known).select("features", LABEL), "evaluation")
    errors = model.stages[-1].evaluateEachIteration(ready, "squared")
    curve = [(i, float(e), float(e) ** 0.5) for i, e in enumerate(errors, 1)]
    return spark.createDataFrame(curve, "round int, mse double, rmse double")


def scorer(model: PipelineModel, version: str, features: list[str] = TRAINING_FEATURES):
    """The model as a `score` function of batch and stream scoring."""

    def score(rows: DataFrame) -> DataFrame:
        return predict(model, rows, features).withColumn("model_version", F.lit(version))

    return score


def feature_importance(
    spark: SparkSession, model: PipelineModel, features: list[str] = TRAINING_FEATURES
) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


@dataclass(frozen=True)
class TrainingRun:
    model: PipelineModel
    metrics: dict[str, float]
    version: str
    path: str


def run_training(
    training_set: DataFrame,
    root: str,
    version: str,
    trained_at: str,
    name: str = "delivery_time",
    features: list[str] = TRAINING_FEATURES,
    **params,
) -> TrainingRun:
    """Split, fit, evaluate, save, register. Raises when there is no data."""
    # Stored once: fitting reads it many times, and a lost executor must not recompute features.
    data = write_through(with_split(training_set.select("order_id", LABEL, *features)), "training")
    counts = data.agg(F.count_if("is_test").alias("test"), F.count(F.lit(1)).alias("all")).first()
    if counts["all"] == 0:
        raise ValueError("no training data")
    model = fit(data.where(~F.col("is_test")), features, **params)
    scored = predict(model, data.where("is_test"), features)
    found = regression_metrics(scored, LABEL, "predicted_delivery_minutes").first()
    metrics = {
        "mae": found["mae"],
        "rmse": found["rmse"],
        "r2": found["r2"],
        "train_size": float(counts["all"] - counts["test"]),
        "test_size": float(counts["test"]),
    }
    path = f"{root}/models/{name}/{version}"
    model.write().overwrite().save(path)
    register(training_set.sparkSession, root, name, version, metrics, path, trained_at)
    return TrainingRun(model, metrics, version, path)


def register(
    spark: SparkSession,
    root: str,
    name: str,
    version: str,
    metrics: dict[str, float],
    path: str,
    trained_at: str,
) -> None:
    row = spark.createDataFrame(
        [(name, version, metrics, path, trained_at)],
        "model_name string, version string, metrics map<string,double>, path string, trained_at string",
    )
    append_log(row.withColumn("trained_at", F.col("trained_at").cast("timestamp")), f"{root}/registry")


def registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(
        "model_name string, version string, metrics map<string,double>, path string, "
        "trained_at timestamp"
    ).parquet(f"{root}/registry")


def latest_run(spark: SparkSession, root: str, name: str = "delivery_time") -> Row:
    """Registry row of the most recently trained model."""
    newest = (
        registry(spark, root)
        .where(F.col("model_name") == name)
        .orderBy(F.col("trained_at").desc(), F.col("version").desc())
        .first()
    )
    if newest is None:
        raise ValueError(f"no model named {name!r}")
    return newest


def load_latest(spark: SparkSession, root: str, name: str = "delivery_time") -> PipelineModel:
    """The most recently trained model: a registry query, not a copied file."""
    return PipelineModel.load(latest_run(spark, root, name)["path"])
