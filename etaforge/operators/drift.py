"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etaforge.operators.ranks import (
    exact_quantiles,
    ks_distance,
    ks_p_value,
    unpivot_numeric,
)

# Thresholds and sample sizes of the drift tests.
P_VALUE_THRESHOLD = 0.05
PSI_THRESHOLD = 0.2
PSI_BINS = 10
PSI_FLOOR = 1e-4
MIN_SAMPLE = 10
MIN_LOGGED_PREDICTIONS = 100
RECENT_PREDICTIONS = 500
MIN_KNOWN_ACTUALS = 10


def two_samples(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Both samples in one frame with a `side` column; only columns both of them have."""
    shared = shared_columns(reference, current, columns)
    return reference.select(*shared, F.lit("ref").alias("side")).unionByName(
        current.select(*shared, F.lit("cur").alias("side"))
    )


def shared_columns(reference: DataFrame, current: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in reference.columns and c in current.columns]


def reference_profile(reference: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample standard deviation, min, max and exact median per numeric column."""
    numeric = [
        name
        for name, kind in reference.dtypes
        if name in columns and kind in ("double", "float", "bigint", "int")
    ]
    moments = (
        unpivot_numeric(reference, numeric)
        .groupBy("feature")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    median = exact_quantiles(reference, numeric, [0.5]).select(
        "feature", F.col("quantile").alias("median")
    )
    return moments.join(F.broadcast(median), "feature")


def ks_test(samples: DataFrame, columns: list[str], min_current: int = 0) -> DataFrame:
    """KS test per column of a `two_samples` frame; too small a side is never drifted.

    Columns with fewer than `min_current` current values give no row.
    """
    return ks_results(ks_distance(samples, columns).where(F.col("n_cur") >= min_current))


def ks_results(distances: DataFrame) -> DataFrame:
    """Drift results from the rows of `ks_distance`."""
    enough = (F.col("n_ref") >= MIN_SAMPLE) & (F.col("n_cur") >= MIN_SAMPLE)
    p = ks_p_value(F.col("d"), F.col("n_ref"), F.col("n_cur"))
    return distances.select(
        F.col("feature").alias("feature_name"),
        F.lit("ks_test").alias("test_name"),
        F.when(enough, F.col("d")).otherwise(0.0).alias("statistic"),
        F.when(enough, p).otherwise(1.0).alias("p_value"),
        F.coalesce(enough & (p < P_VALUE_THRESHOLD), F.lit(False)).alias("is_drifted"),
        F.lit(P_VALUE_THRESHOLD).alias("threshold"),
        F.when(enough, F.col("ref_mean")).alias("reference_mean"),
        F.when(enough, F.col("cur_mean")).alias("current_mean"),
    )


def psi_components(samples: DataFrame, columns: list[str], bins: int = PSI_BINS) -> DataFrame:
    """Per column: sample sizes, means, `psi_ratio` = sum((c-r)*c/r), `psi_log` = sum((c-r)*ln(c/r)).

    Bins are equal-width over the pooled range, closed on the right, the minimum in bin 1.
    """
    is_ref = (F.col("side") == "ref").alias("is_ref")
    values = unpivot_numeric(samples, columns, keep=[is_ref])
    ranges = values.groupBy("feature").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count_if("is_ref").alias("n_ref"),
        F.count_if(~F.col("is_ref")).alias("n_cur"),
        F.avg(F.when(F.col("is_ref"), F.col("value"))).alias("reference_mean"),
        F.avg(F.when(~F.col("is_ref"), F.col("value"))).alias("current_mean"),
    )
    bin_no = psi_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    counts = (
        values.join(F.broadcast(ranges.select("feature", "low", "high")), "feature")
        .groupBy("feature", bin_no.alias("bin"))
        .agg(F.count_if("is_ref").alias("r"), F.count_if(~F.col("is_ref")).alias("c"))
    )
    return psi_scores(ranges, counts, bins)


def psi_bin(value: Column, low: Column, high: Column, bins: int = PSI_BINS) -> Column:
    """Number of the equal-width bin, closed on the right; 1 in a flat range."""
    place = F.ceil(F.try_divide(value - low, (high - low) / bins))
    return F.coalesce(F.least(F.lit(bins), F.greatest(F.lit(1), place)), F.lit(1))


def psi_scores(ranges: DataFrame, counts: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Both forms of PSI from each feature's range and sizes and its counts per bin."""
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))

    def share(count: str, total: str):
        part = F.try_divide(F.coalesce(F.col(count), F.lit(0)), F.col(total))
        return F.greatest(part, F.lit(PSI_FLOOR))

    r, c = share("r", "n_ref"), share("c", "n_cur")
    flat = F.col("low") == F.col("high")
    return (
        grid.join(F.broadcast(counts), ["feature", "bin"], "left")
        .groupBy("feature", "n_ref", "n_cur", "reference_mean", "current_mean", "low", "high")
        .agg(F.sum((c - r) * (c / r)).alias("ratio"), F.sum((c - r) * F.ln(c / r)).alias("log"))
        .select(
            "feature",
            "n_ref",
            "n_cur",
            "reference_mean",
            "current_mean",
            F.when(flat, 0.0).otherwise(F.col("ratio")).alias("psi_ratio"),
            F.when(flat, 0.0).otherwise(F.col("log")).alias("psi_log"),
        )
    )


def psi_test(samples: DataFrame, columns: list[str], form: str = "psi_ratio") -> DataFrame:
    """PSI per column as a drift result; `form` is `psi_ratio` or the usual `psi_log`."""
    return psi_results(psi_components(samples, columns), form)


def psi_results(components: DataFrame, form: str = "psi_ratio") -> DataFrame:
    """Drift results from the rows of `psi_components`."""
    enough = (F.col("n_ref") >= MIN_SAMPLE) & (F.col("n_cur") >= MIN_SAMPLE)
    psi = F.col(form)
    return components.select(
        F.col("feature").alias("feature_name"),
        F.lit("psi").alias("test_name"),
        F.when(enough, psi).otherwise(0.0).alias("statistic"),
        F.when(enough, 1 - F.least(psi / PSI_THRESHOLD, F.lit(1.0))).otherwise(1.0).alias("p_value"),
        (enough & (psi > PSI_THRESHOLD)).alias("is_drifted"),
        F.lit(PSI_THRESHOLD).alias("threshold"),
        F.when(enough, F.col("reference_mean")).alias("reference_mean"),
        F.when(enough, F.col("current_mean")).alias("current_mean"),
    )


def check_all_features(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """KS and PSI for every column both samples have: one row per (feature, test)."""
    shared = shared_columns(reference, current, columns)
    samples = two_samples(reference, current, shared)
    return ks_test(samples, shared).unionByName(psi_test(samples, shared))


def drift_report(results: DataFrame) -> DataFrame:
    """One summary row. The list is bounded by the number of (feature, test) pairs."""
    label = F.concat_ws(":", "feature_name", "test_name")
    return results.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if("is_drifted").alias("drifted_count"),
        (F.count_if("is_drifted") > 0).alias("drift_detected"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("is_drifted"), label))), ","
        ).alias("drifted_features"),
    )


def prediction_drift(reference: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """KS test of the latest logged predictions against reference ones; no row for a short log."""
    recent = log.orderBy(*(F.col(c).desc() for c in order)).limit(RECENT_PREDICTIONS)
    samples = two_samples(
        reference.select(F.col("prediction").alias("predictions")),
        recent.select(F.col("prediction").alias("predictions")),
        ["predictions"],
    )
    # The sample is as long as the log until it reaches its own limit.
    return ks_test(samples, ["predictions"], min_current=MIN_LOGGED_PREDICTIONS)


def error_stats(scored: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """MAE and bias over rows with a known actual; no row below the minimum sample."""
    error = F.col(prediction) - F.col(actual)
    return (
        scored.where(F.col(actual).isNotNull())
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error).alias("mean_error"),
            F.count(F.lit(1)).alias("n_samples"),
        )
        .where(F.col("n_samples") >= MIN_KNOWN_ACTUALS)
    )
