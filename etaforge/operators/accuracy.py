"""Prediction accuracy against actual delivery times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etaforge.functions.guards import percent_of
from etaforge.operators.joins import side_by_side
from etaforge.operators.ranks import exact_quantiles, unpivot_all

BANDS = (5, 10, 15)


def predictions_with_actuals(predictions: DataFrame, delivered: DataFrame) -> DataFrame:
    """Inner join on the order: one row per model version of a delivered order."""
    actuals = delivered.select(
        "order_id", "delivered_at", F.col("delivery_time_minutes").alias("actual_delivery_minutes")
    )
    return predictions.join(actuals, "order_id")


def with_errors(joined: DataFrame) -> DataFrame:
    """Signed, absolute and percentage error; the percentage of a zero actual is NULL."""
    error = F.col("predicted_delivery_minutes") - F.col("actual_delivery_minutes")
    return joined.withColumns(
        {
            "error": error,
            "absolute_error": F.abs(error),
            "percentage_error": percent_of(F.abs(error), F.col("actual_delivery_minutes")),
        }
    )


def overall(errors: DataFrame) -> DataFrame:
    sums = errors.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("percentage_error").alias("mean_percentage_error"),
        F.count_if(F.col("actual_delivery_minutes") == 0).alias("zero_actuals"),
    )
    median = exact_quantiles(errors, ["absolute_error"], [0.5]).select(
        F.col("quantile").alias("median_absolute_error")
    )
    return side_by_side(sums, median)


def bands(errors: DataFrame, minutes: tuple[int, ...] = BANDS) -> DataFrame:
    """Count and percentage of predictions within each number of minutes (inclusive)."""
    counts = errors.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("absolute_error") <= m).alias(f"within_{m}") for m in minutes),
    )
    rows = F.array(
        *(
            F.struct(F.lit(m).cast("long").alias("minutes"), F.col(f"within_{m}").alias("within"))
            for m in minutes
        )
    )
    return counts.select("n", F.inline(rows)).select(
        "minutes", "within", percent_of(F.col("within"), F.col("n")).alias("percent")
    )


def by_store(errors: DataFrame) -> DataFrame:
    return errors.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("num_orders"),
        F.avg("absolute_error").alias("avg_error"),
        F.avg("predicted_delivery_minutes").alias("avg_predicted"),
        F.avg("actual_delivery_minutes").alias("avg_actual"),
    )


def extreme_rows(df: DataFrame, by: str, k: int, worst: bool, ties: list[str]) -> DataFrame:
    """Top-k by `by`, ties broken by unique columns; a partial top-k per task, never a full sort."""
    first = F.col(by).desc_nulls_last() if worst else F.col(by).asc_nulls_last()
    return df.orderBy(first, *ties).limit(k)


def describe(df: DataFrame, columns: list[str], method: str = "linear") -> DataFrame:
    """Count, nulls, mean, std, min, exact quartiles and max, one row per column."""
    moments = (
        unpivot_all(df, columns)
        .groupBy("feature")
        .agg(
            F.count("value").alias("count"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], method)

    def at(p: float):
        return F.max(F.when(F.col("probability") == p, F.col("quantile")))

    wide = quartiles.groupBy("feature").agg(
        at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75")
    )
    return (
        moments.join(F.broadcast(wide), "feature", "left")  # one row per column
        .select(
            F.col("feature").alias("column_name"),
            "count", "null_count", "mean", "std", "min", "q25", "median", "q75", "max",
        )
    )


def over_time(errors: DataFrame, width: str = "7 days") -> DataFrame:
    """MAE and bias per tumbling window of delivery time."""
    return (
        errors.groupBy(F.window("delivered_at", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("absolute_error").alias("mae"),
            F.avg("error").alias("bias"),
        )
        .select(F.col("w.start").alias("week_start"), "n", "mae", "bias")
    )


def regression_metrics(
    scored: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """MAE, RMSE and R2 in one pass, per value of the columns `by`."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
    )
